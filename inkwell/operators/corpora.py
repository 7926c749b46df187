"""Corpus and model preparation: evaluation, calibration, splits, samples, chunks, reply cleaning, case building, training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.preparing import packed
from inkwell.tables import stored


def scored_rates(scores: DataFrame, keys: list[str]) -> DataFrame:
    """For each of keys, and over all of them: n, mean score, share flagged (scores: keys, label, score, flagged)."""
    g = scores.groupingSets([["label", *keys], ["label"]], "label", *keys)
    return g.agg(F.count("*").alias("n"), (F.floor(F.sum(F.round(F.col("score") * 1_000_000).cast("long")) / F.count("*") + 0.5) / 1e6).alias("mean_score"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("flagged"))


def area_under_curve(scores: DataFrame, digits: int = 4) -> DataFrame:
    """n_positive, n_negative, auroc of (label 0/1, score in 0 to 1), ties one half; scores count to `digits` places.

    Scores are grouped first, so the ordered part is over 10^digits + 1 rows at most, however many documents there are."""
    g = scores.groupBy(F.round("score", digits).alias("s")).agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    w = g.withColumn("below", below)
    return w.agg(F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"), F.round(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n")), 6).alias("auroc"))


def calibrate(scores: DataFrame, rate: float = 0.01) -> DataFrame:
    """threshold, false_positive_rate, detection_rate: the threshold is the (1 - rate) quantile of even-numbered negatives, the
    rates are of odd-numbered negatives and of positives (scores: ix, label, score)."""
    t = scores.where("label = 0 and ix % 2 = 0").agg(F.expr(f"percentile(round(score, 4), {1 - rate})").alias("threshold"))
    s = scores.join(F.broadcast(t))  # one row
    hit = F.col("score") >= F.col("threshold")
    return s.groupBy("threshold").agg(F.round(F.avg(F.when((F.col("label") == 0) & (F.col("ix") % 2 == 1), hit.cast("int"))), 6).alias("false_positive_rate"), F.round(F.avg(F.when(F.col("label") == 1, hit.cast("int"))), 6).alias("detection_rate")).withColumn("threshold", F.round("threshold", 6))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    z = 1.959964
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.round(mid - half, 6), F.round(mid + half, 6)


def md5_digit(key: Column) -> Column:
    """The md5 of a key, modulo 10: powers of 16 end in 6, so digits add up without big numbers."""
    h = F.md5(key.cast("binary"))
    digit = lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int")
    high = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(31)), digit), F.lit(0), lambda s, x: s + x)
    return F.pmod(6 * high + digit(F.lit(32)), F.lit(10))


def hash_share(key: Column) -> Column:
    """A number in [0, 1) from a key's md5 (52 bits)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str, bins: int = 4096) -> DataFrame:
    """At most n rows of each stratum, those with the least hash of key.

    No stratum is sorted whole: counts by hash bin tell in which bin the n-th row is, and only that bin's rows are ranked."""
    d = df.withColumn("_u", hash_share(F.col(key).cast("string"))).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    per = d.groupBy(*strata, "_bin").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*strata).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    per = per.withColumn("_before", upto - F.col("_n")).where(F.col("_before") < n)
    same = [F.col(f"d.{s}").eqNullSafe(F.col(f"p.{s}")) for s in strata] + [F.col("d._bin") == F.col("p._bin")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = d.alias("d").join(per.alias("p"), cond).select("d.*", "p._before", "p._n")
    whole = j.where(F.col("_before") + F.col("_n") <= n)
    last = j.where(F.col("_before") + F.col("_n") > n)
    last = last.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy("_u", key))).where(F.col("_r") <= n - F.col("_before")).drop("_r")
    return whole.unionByName(last).select(df.columns)


def truncate(text: Column, n: int = 400) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def chunks(docs: DataFrame, least: int = 150, most: int = 380, each: int = 2, words: int = 25, digits: float = 0.04) -> DataFrame:
    """doc_id, ix, text, words: paragraphs of `words` words or more with few digits, joined to `least` words; chunks over `most`
    are left out, and the first `each` of a document are kept."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n+"), lambda p: F.trim(p)), lambda p: (F.size(F.split(p, r"\s+")) >= words) & (F.regexp_count(p, F.lit("[0-9]")) < digits * F.greatest(F.length(p), F.lit(1))))
    d = docs.select("doc_id", lines.alias("ps"))
    d = d.withColumn("c", F.filter(packed(F.transform("ps", lambda p: F.size(F.split(p, r"\s+"))), least, 0), lambda x: (x["size"] >= least) & (x["size"] <= most)))
    d = d.select("doc_id", "ps", F.posexplode(F.slice("c", 1, each)).alias("ix", "x"))
    return d.select("doc_id", "ix", F.array_join(F.slice("ps", F.col("x.first"), F.col("x.last") - F.col("x.first") + 1), "\n\n").alias("text"), F.col("x.size").alias("words"))


#: Replies that are no paragraph.
PREAMBLE = r"(?i)^(?:here is|here's|sure|certainly|of course|below is)(?:[^A-Za-z0-9_]|$)"
REFUSAL = r"(?i)^(?:I can(?:no|['’])t|I won['’]t|I['’]m (?:sorry|unable|not able)|Sorry(?:[^A-Za-z0-9_]|$)|I (?:do not|don['’]t) (?:feel|think) comfortable)"
CHATTER = r"(?i)(?:^|[^A-Za-z0-9_])here(?:['’]s| is) (?:the|your|an?) (?:improved|polished|revised|rewritten|edited|translated|final|result|paragraph|translation|version)"


def usable_reply(reply: Column, least: int = 60) -> Column:
    """The paragraph alone, up to 400 words, or null: prefaces dropped, refusals, chatter, short and broken-off replies out."""
    t = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^[\s\"“”]+|[\s\"“”]+$", "")
    t = F.when(t.rlike(PREAMBLE), F.trim(F.regexp_replace(t, r"(?s)^[^\n]*(?:\n|$)", ""))).otherwise(t)
    w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    good = ~t.rlike(REFUSAL) & ~t.rlike(CHATTER) & (F.size(w) >= least) & t.rlike(r"[.!?)\]\"”]$")
    return F.when(good, F.array_join(F.slice(w, 1, 400), " "))


def polish_label(kind: Column, degree: Column, percent: Column) -> Column:
    by_degree = F.when(degree.isin("major", "slight_major"), "ai").when(degree == "extreme_minor", "human")
    return F.when(kind == "degree-based", by_degree).otherwise(F.when(percent >= 35, "ai").when(percent <= 5, "human"))


def job_plan(rows: DataFrame, models: list[str], each: int, mix: dict[str, float], seed: int = 13) -> DataFrame:
    """id, model, kind, turn: rows are dealt to models in turn, `each` to one; kinds are drawn by weight from the row's own hash,
    so a smaller plan is the start of a larger one. Only the rows of least hash, as many as are dealt, are ordered."""
    need = len(models) * each
    u = hash_share(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    few = rows.select("id").withColumn("u", u).orderBy("u", "id").limit(need)
    few = few.withColumn("n", F.row_number().over(W.orderBy("u", "id")) - 1)
    v = hash_share(F.concat(F.lit(f"kind:{seed}:"), F.col("id").cast("string"))) * sum(mix.values())
    kind, upto = None, 0.0
    for name, weight in mix.items():
        upto += weight
        kind = F.when(v < upto, name) if kind is None else kind.when(v < upto, name)
    model = F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("n") % len(models) + 1).cast("int"))
    return few.select("id", model.alias("model"), kind.otherwise(list(mix)[-1]).alias("kind"), F.floor(F.col("n") / len(models)).alias("turn"))


#: Everyday academic swaps for test cases.
SWAPS = tuple(
    tuple(p.split("="))
    for p in (
        "show=demonstrate shows=demonstrates showed=demonstrated use=employ used=employed using=employing important=significant method=approach methods=approaches result=finding results=findings study=investigation increase=rise "
        "increased=elevated decrease=decline decreased=reduced large=substantial small=limited however=nevertheless also=additionally new=novel different=distinct improve=enhance improved=enhanced provide=offer provides=offers "
        "suggest=indicate suggests=indicates effect=impact effects=impacts analysis=examination analyzed=examined analysed=examined data=observations high=elevated low=reduced main=principal total=overall need=requirement based=founded "
        "performance=effectiveness approach=strategy found=observed major=key several=multiple various=diverse help=assist obtained=acquired"
    ).split()
)


def edited(sentence: Column, seed: Column) -> Column:
    """Every sixth word is dropped or becomes 'notably', by a hash of seed and place."""
    w = F.filter(F.split(sentence, r"\s+"), lambda x: x != "")
    drop = lambda i: F.crc32(F.concat(seed.cast("string"), F.lit(":"), i.cast("string")).cast("binary")) % 2 == 0
    return F.array_join(F.filter(F.transform(w, lambda x, i: F.when(i % 6 != 5, x).when(drop(i), F.lit("")).otherwise(F.lit("notably"))), lambda x: x != ""), " ")


def reworded(sentence: Column) -> Column:
    """Known words swapped, capitals kept; null if fewer than three were."""
    table = F.create_map(*[F.lit(x) for p in SWAPS for x in p])
    w = F.filter(F.split(sentence, r"\s+"), lambda x: x != "")
    bare = lambda x: F.regexp_extract(x, r"^([A-Za-z]+)[^A-Za-z0-9_]*$", 1)
    to = lambda x: F.try_element_at(table, F.lower(bare(x)))
    cased = lambda x: F.when(bare(x).rlike("^[A-Z]"), F.concat(F.upper(F.left(to(x), F.lit(1))), F.substring(to(x), F.lit(2), F.length(to(x))))).otherwise(to(x))
    new = F.transform(w, lambda x: F.coalesce(F.concat(cased(x), F.substring(x, F.length(bare(x)) + 1, F.length(x))), x))
    return F.when(F.size(F.filter(w, lambda x: to(x).isNotNull())) >= 3, F.array_join(new, " "))


def good_sentences(docs: DataFrame, least: int = 15, most: int = 40) -> DataFrame:
    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))
    n = F.size(F.filter(F.split("sentence", r"\s+"), lambda x: x != ""))
    return s.where(n.between(least, most))


def quantised(weights: DataFrame) -> DataFrame:
    """h, q, scale: weights as whole numbers from -127 to 127 of one scale."""
    scale = weights.agg((F.max(F.abs("w")) / 127).alias("scale"))
    q = F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.round(F.col("w") / F.col("scale"))))
    return weights.join(F.broadcast(scale)).select("h", F.when(F.col("scale") > 0, q).otherwise(0.0).cast("int").alias("q"), "scale")


def libsvm_lines(features: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line: 'label index:value ...' with indices from 1 and five places (features: doc_id, h, value)."""
    f = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("f"))
    line = F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("f", lambda x: F.format_string("%d:%.5f", x["h"] + 1, x["value"])), " "))
    return f.join(labels, "doc_id").select("doc_id", line.alias("line"))


def train(features: DataFrame, labels: DataFrame, c: float = 4.0, weight: float = 1.5, size: int = 1 << 18) -> tuple[DataFrame, float]:
    """(weights (h, w), bias) of a logistic regression by Spark ML; label 0 weighs `weight`. What leaves Spark is `size` numbers."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructType

    g = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("h").cast("int").alias("h"), "value"))).alias("f")).join(labels, "doc_id")
    # a sparse vector is stored as a struct of this form, so a stored struct reads back as vectors without any Python
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform("f", lambda x: x["h"]).alias("indices"), F.transform("f", lambda x: x["value"].cast("double")).alias("values"))
    kept = stored(g.select(sparse.alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 0, weight).otherwise(1.0).alias("w")), "vectors")
    rows = features.sparkSession.read.schema(StructType().add("features", VectorUDT()).add("label", DoubleType()).add("w", DoubleType())).parquet(kept.stored_at)
    n = rows.count()
    model = LogisticRegression(regParam=1.0 / (c * max(n, 1)), weightCol="w", maxIter=60, standardization=False).fit(rows)
    found = [(int(i), float(v)) for i, v in zip(*((model.coefficients.indices, model.coefficients.values) if hasattr(model.coefficients, "indices") else (range(size), model.coefficients.toArray())), strict=True) if v]
    return features.sparkSession.createDataFrame(found or [(0, 0.0)], "h long, w double"), float(model.intercept)


def best_originals(polished: DataFrame, originals: DataFrame) -> DataFrame:
    """id, original, similarity: the original of the same domain that shares most words (Jaccard) with each polished text.

    Words meet in an equi-join on domain and word; counts of distinct words give the union."""
    words = lambda d: d.select("id", "domain", F.explode(F.array_distinct(T.matches(F.lower("text"), "[a-z]+"))).alias("w"))
    a, b = words(polished), words(originals)
    size = lambda d, n: d.groupBy("id").agg(F.count("*").alias(n))
    both = a.join(b.withColumnRenamed("id", "original"), ["domain", "w"]).groupBy("id", "original").agg(F.count("*").alias("c"))
    p = both.join(size(a, "n"), "id").join(size(b, "m").withColumnRenamed("id", "original"), "original")
    p = p.withColumn("j", F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    return p.groupBy("id").agg(F.max_by("original", F.struct("j", F.col("original"))).alias("original"), F.round(F.max("j"), 6).alias("similarity"))
