"""Machine-writing patterns: stock phrases, openers, signals, hashed features, a linear model, windows, shares and merges.

Weights of the linear model are the caller's (a table of h, w); `train` in plans.corpora fits them with Spark ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import CLICHES, TRANSITIONS
from inkwell.operators import scoring as V
from inkwell.operators import statistics as S

#: Thresholds, percentiles and weights of the verdicts.
MIN_WORDS = 80
LIKELY_AI, LIKELY_AI_SHORT, LIKELY_HUMAN = 0.8641, 0.93, 0.15
PERCENTILES = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.994)
ANCHOR = 0.8
SIGNAL_WEIGHTS = {"burstiness": 1.4, "lexical_diversity": 0.6, "cliches": 1.2, "transitions": 1.0}


def _escaped(p: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in p)


#: Longer phrases first; one that ends in a comma ends there, others before a character that is no part of a word.
CLICHE = r"(?:^|[^A-Za-z0-9_])(" + "|".join(_escaped(p) if p.endswith(",") else _escaped(p) for p in sorted(dict(CLICHES), key=lambda p: (-len(p), p))) + ")"
OPENER = r"^[\s\"“(]*(" + "|".join(_escaped(t) for t in sorted(TRANSITIONS, key=lambda t: (-len(t), t))) + r")(?:[^A-Za-z0-9_]|$)"


def cliches(text: Column) -> Column:
    """Stock phrases in text, lower case, in order; a match that runs on into a word is no phrase."""
    t = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.transform(F.regexp_extract_all(t, F.lit(CLICHE + r"(?:[^A-Za-z0-9_]|$)"), F.lit(1)), lambda p: p)


def _weight(phrase: Column) -> Column:
    three, two = [p for p, w in CLICHES if w == 3], [p for p, w in CLICHES if w == 2]
    return F.when(phrase.isin(three), 3).when(phrase.isin(two), 2).otherwise(1)


def opener(sentence: Column) -> Column:
    """The connective that a sentence opens with, lower case; empty if none."""
    return F.regexp_extract(F.lower(sentence), T.re2(OPENER), 1)


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, words, four values and leans, score: the statistical signals and what they add up to."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "text", T.simple_sentences(text).alias("s"), cliches(text).alias("c"))
    d = d.withColumn("l", F.filter(F.transform("s", T.word_count), lambda n: n >= 4))
    d = d.withColumn("length_cv", F.when(F.size("l") >= 3, S.variation(F.col("l"))).otherwise(F.lit(0.45)))
    d = d.withColumn("w", F.aggregate(F.transform("c", _weight), F.lit(0), lambda a, x: a + x)).withColumn("n", T.word_count(text))
    d = d.withColumn("per_1000", F.when(F.col("n") > 0, F.col("w") / F.col("n") * 1000).otherwise(F.lit(0.0)))
    d = d.withColumn("opened", F.when(F.size("s") > 0, F.size(F.filter("s", lambda s: opener(s) != "")) / F.size("s")).otherwise(F.lit(0.0)))
    d = d.join(S.moving_type_token_ratio(docs).select("doc_id", "mattr"), "doc_id", "left").withColumn("mattr", F.coalesce("mattr", F.lit(0.0)))
    r2 = lambda c: T.half_up(c, 2)
    v, m, o = F.col("length_cv"), F.col("mattr"), F.col("opened")
    leans = {
        "burstiness": r2(T.ramp(v, 0.22, 1, 0.62, -1)), "lexical_diversity": r2(F.when(m < 0.7, T.ramp(m, 0.6, 0.6, 0.7, 0)).otherwise(T.ramp(m, 0.7, 0, 0.82, -0.6))),
        "cliches": r2(F.when(F.col("per_1000") <= 2, T.ramp(F.col("per_1000"), 0, -0.4, 2, 0)).otherwise(T.ramp(F.col("per_1000"), 2, 0, 9, 1))),
        "transitions": r2(F.when(o <= 0.12, T.ramp(o, 0.03, -0.5, 0.12, 0)).otherwise(T.ramp(o, 0.12, 0, 0.32, 1))),
    }
    total = sum((leans[k] * w for k, w in SIGNAL_WEIGHTS.items()), F.lit(0.0)) / sum(SIGNAL_WEIGHTS.values())
    return d.select("doc_id", F.col("n").alias("words"), F.round(v, 6).alias("length_cv"), "mattr", F.round("per_1000", 6).alias("per_1000"), F.round(o, 6).alias("opened"), *[x.alias(f"lean_{k}") for k, x in leans.items()], F.round(100 / (1 + F.exp(-3 * total)), 4).alias("score"))


def hashed_features(docs: DataFrame) -> DataFrame:
    """doc_id, h, value: hashed words, pairs and function-word skeletons as log counts of unit length.

    Counted in the tasks that read the texts; only texts that share a doc_id meet in a shuffle."""
    f = V.counts(docs)
    if V.single(docs):
        return f.select("doc_id", "h", "value")
    c = f.groupBy("doc_id", "h").agg(F.sum("c").alias("c"))
    norm = F.sqrt(F.sum(F.log1p("c") * F.log1p("c")).over(W.partitionBy("doc_id")))
    return c.select("doc_id", "h", (F.log1p("c") / norm).alias("value"))


def feature_sums(docs: DataFrame) -> DataFrame:
    """doc_id, features, h_sum, checksum, norm: what hashed_features adds up to, without its rows."""
    if V.single(docs):
        return V.feature_sums(docs)
    f = hashed_features(docs)
    return f.groupBy("doc_id").agg(F.count("*").alias("features"), F.sum("h").alias("h_sum"), F.sum(F.col("value") * (F.col("h") % 97)).alias("checksum"), F.sum(F.col("value") * F.col("value")).alias("norm"))


def text_probability(docs: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """model_probability of the features of docs."""
    return V.text_logits(docs, V.vector(weights), bias) if V.single(docs) else model_probability(hashed_features(docs), weights, bias)


def model_probability(features: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """doc_id, logit, probability: features (doc_id, h, value) by weights (h, w), which has at most 2^18 rows."""
    s = features.join(weights, "h", "left").groupBy("doc_id").agg(F.sum(F.col("value") * F.coalesce("w", F.lit(0.0))).alias("s"))
    z = F.col("s") + bias
    return s.select("doc_id", z.alias("logit"), (1 / (1 + F.exp(-z))).alias("probability"))


def top_contributors(docs: DataFrame, weights: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, phrase, weight: words and pairs that push a text up most."""
    if V.single(docs):
        return V.best_phrases(docs, V.vector(weights), most).select("doc_id", "phrase", F.round("w", 2).alias("weight"))
    t = docs.select("doc_id", T.feature_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    one = F.filter("t", lambda a: a.rlike(r"^\p{L}{3,}$"))
    two = F.filter(F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.size("t")), lambda a, b: F.when(a.rlike(r"^\p{L}") & b.rlike(r"^\p{L}"), F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())
    p = t.select("doc_id", F.explode(F.array_distinct(F.concat(one, two))).alias("phrase")).distinct()
    p = p.withColumn("h", T.fnv18(F.concat(F.when(F.contains("phrase", F.lit(" ")), F.lit("b:")).otherwise(F.lit("u:")), F.col("phrase"))))
    p = p.join(weights, "h").where("w > 0").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("w"), "phrase")))
    return p.where(F.col("r") <= most).select("doc_id", "phrase", F.round("w", 2).alias("weight"))


def verdict(words: Column, p: Column) -> Column:
    bar = F.when(words >= 150, F.lit(LIKELY_AI)).otherwise(F.lit(LIKELY_AI_SHORT))
    return F.when(words < MIN_WORDS, "insufficient_text").when(p >= bar, "likely_ai").when(p <= LIKELY_HUMAN, "likely_human").otherwise("uncertain")


def document_verdict(windows: DataFrame) -> DataFrame:
    """doc_id, score, low, high, verdict from windows (doc_id, start, end, probability, words: of the document)."""
    size = F.col("end") - F.col("start")
    g = windows.groupBy("doc_id").agg((F.sum(F.col("probability") * size) / F.sum(size)).alias("p"), F.coalesce(F.stddev_samp("probability"), F.lit(0.0)).alias("spread"), F.max("words").alias("words"))
    clamp = lambda x, lo, hi: F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))
    half = clamp(clamp(10 * F.sqrt(300 / F.greatest("words", F.lit(1))), 4, 40) + F.col("spread") * 25, 4, 45)
    s = F.col("p") * 100
    whole = lambda x: F.floor(F.round(x, 9) + 0.5).cast("int")
    return g.select("doc_id", whole(s).alias("score"), whole(clamp(s - half, 0, 100)).alias("low"), whole(clamp(s + half, 0, 100)).alias("high"), verdict(F.col("words"), F.col("p")).alias("verdict"))


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def spread(lengths: Column, most: int = 5) -> Column:
    """Sample deviation by mean of up to `most` lengths, by Welford's steps in their order as SQL engines take them: where it falls
    on a limit, the last bit decides. 0 for a single length, null for none."""
    lengths = F.col(lengths) if isinstance(lengths, str) else lengths
    n, mean, square = F.size(lengths), F.lit(0.0), F.lit(0.0)
    for k in range(most):
        x = F.get(lengths, F.lit(k)).cast("double")
        off = x - mean
        square = F.when(n > k, square + off * (x - (mean + off / (k + 1)))).otherwise(square)
        mean = F.when(n > k, mean + off / (k + 1)).otherwise(mean)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(n > 0, F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(F.lit(0.0)) / (total / n))


def sentence_scores(docs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """doc_id, ix, score, level: local cues, smoothed over neighbours; blended with the tightest region (doc_id, first, last,
    probability, in sentences) around the sentence, if there is one."""
    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "s"))
    s = s.withColumn("words", T.word_count(F.col("s"))).where("words > 0")
    doc = W.partitionBy("doc_id").orderBy("ix")
    near = doc.rowsBetween(-2, 2)
    long = F.when(F.col("words") >= 4, F.col("words"))
    s = s.withColumn("near", F.collect_list(long).over(near)).withColumn("n", F.size("near")).withColumn("spread", spread(F.col("near"))).withColumn("avg", F.coalesce(F.avg(long).over(W.partitionBy("doc_id")), F.lit(1.0)))
    weight = F.aggregate(F.transform(cliches(F.col("s")), _weight), F.lit(0), lambda a, x: a + x)
    lean = F.least(F.lit(1.2), weight * 0.35) + F.when(opener(F.col("s")) != "", 0.35).otherwise(0.0)
    lean += F.when((F.col("n") >= 4) & (F.col("spread") < 0.15), 0.3).when((F.col("n") >= 4) & (F.col("spread") > 0.5), -0.2).otherwise(0.0)
    lean += F.when((F.col("words") <= 6) & (F.col("words") < F.col("avg") * 0.4), -0.25).otherwise(0.0)
    lean += F.when(F.concat(F.lit(" "), "s", F.lit(" ")).rlike(r"[?!] \z|[^A-Za-z0-9_](?:I|my|we've|I'm|I've)[^A-Za-z0-9_]"), -0.15).otherwise(0.0)
    s = s.withColumn("lean", lean)
    smooth = 0.7 * F.col("lean") + 0.15 * F.coalesce(F.lag("lean").over(doc), F.col("lean")) + 0.15 * F.coalesce(F.lead("lean").over(doc), F.col("lean"))
    s = s.withColumn("local", 1 / (1 + F.exp(-(smooth * 2.2 - 0.9))))
    score = F.col("local")
    if regions is not None:
        inside = s.select("doc_id", "ix").join(regions, "doc_id").where((F.col("ix") >= F.col("first")) & (F.col("ix") <= F.col("last")))
        around = inside.groupBy("doc_id", "ix").agg(F.min_by("probability", F.struct(F.col("last") - F.col("first"), "first")).alias("around"))
        s = s.join(around, ["doc_id", "ix"], "left")
        score = F.when(F.col("around").isNull(), F.col("local")).otherwise(0.6 * F.col("around") + 0.4 * F.col("local"))
    score = T.half_up(F.round(score, 9), 2)
    return s.select("doc_id", "ix", score.alias("score"), level(score).alias("level"))


def human_percentile(p: Column, quantiles: Column) -> Column:
    """Where p falls among human paragraphs, piecewise linear through (quantiles, PERCENTILES)."""
    q = lambda i: F.element_at(quantiles, i + 1)
    k = len(PERCENTILES) - 1
    tiny = 1e-9
    out = PERCENTILES[0] * p / F.greatest(q(0), F.lit(tiny))
    for j in range(k):
        line = PERCENTILES[j] + (p - q(j)) / F.greatest(q(j + 1) - q(j), F.lit(tiny)) * (PERCENTILES[j + 1] - PERCENTILES[j])
        out = F.when((p > q(j)) if j == 0 else (p >= q(j)), line).otherwise(out)
    return F.when(p >= q(k), PERCENTILES[k] + (p - q(k)) / F.greatest(1 - q(k), F.lit(tiny)) * (1 - PERCENTILES[k])).otherwise(out)


def classifier_scale(p: Column, quantiles: Column) -> Column:
    """p on the classifier's scale: up to the 80th percentile of human paragraphs at most LIKELY_HUMAN, then a squared rise."""
    top = F.element_at(quantiles, len(PERCENTILES))
    pct = human_percentile(p, quantiles)
    t = (pct - ANCHOR) / (PERCENTILES[-1] - ANCHOR)
    high = LIKELY_AI + (p - top) / F.greatest(1 - top, F.lit(1e-9)) * (1 - LIKELY_AI)
    return F.when(p >= top, high).when(pct <= ANCHOR, pct / ANCHOR * LIKELY_HUMAN).otherwise(LIKELY_HUMAN + t * t * (LIKELY_AI - LIKELY_HUMAN))


def merge_neural(segments: DataFrame, scores: DataFrame, least: int = 6, percentile: float = 0.9, share: float = 0.55) -> DataFrame:
    """doc_id, segment, probability, document_level: segments (doc_id, segment, words, probability) raised by other models'
    scores (doc_id, segment, model, score, quantiles).

    Where `share` of at least `least` read segments lie above the `percentile` of human writing, all of the document's
    segments past the anchor count as machine-written; elsewhere only a confident score raises its segment."""
    p = scores.groupBy("doc_id", "segment", "model").agg(F.avg("score").alias("m"), F.first("quantiles").alias("q"))
    p = p.groupBy("doc_id", "segment").agg(F.max(human_percentile(F.col("m"), F.col("q"))).alias("pct"), F.max(classifier_scale(F.col("m"), F.col("q"))).alias("neural"))
    s = segments.join(p, ["doc_id", "segment"], "left")
    doc = W.partitionBy("doc_id")
    read, above = F.count("pct").over(doc), F.count(F.when(F.col("pct") >= percentile, 1)).over(doc)
    s = s.withColumn("document_level", (read >= least) & (above >= share * read))
    raised = F.when(F.col("pct").isNull(), F.col("probability")).when(F.col("document_level") & (F.col("pct") >= min(percentile, ANCHOR)), F.greatest("probability", F.lit(LIKELY_AI_SHORT + 0.01)))
    raised = raised.when(F.col("neural") < LIKELY_AI, F.col("probability")).otherwise(T.half_up(F.round(F.greatest("probability", "neural"), 9), 3))
    return s.select("doc_id", "segment", "words", F.round(raised, 6).alias("probability"), "document_level")


def breakdown(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, ai_percent, uncertain_percent, human_percent, words, ai_passages: the classes of tokens (doc_id, pos, block) under
    parts (doc_id, first, last, words, probability, in token places). A document's single part is judged by its own words."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    c = tokens.join(parts.withColumn("parts", n), "doc_id").where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))
    c = c.groupBy("doc_id", "pos", "block").agg(F.avg("probability").alias("p"), F.min("words").alias("w"))
    bar = F.when(F.col("w") >= 150, F.lit(LIKELY_AI)).otherwise(F.lit(LIKELY_AI_SHORT))
    c = c.withColumn("kind", F.when(F.col("p") >= bar, "ai").when(F.col("p") <= LIKELY_HUMAN, "human").otherwise("uncertain"))
    order = W.partitionBy("doc_id").orderBy("pos")
    opens = F.when((F.lag("kind").over(order) == F.col("kind")) & (F.lag("block").over(order) == F.col("block")), 0).otherwise(1)
    c = c.withColumn("opens", opens)
    g = c.groupBy("doc_id").agg(F.count("*").alias("words"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("ai", "human")], F.count_if((F.col("kind") == "ai") & (F.col("opens") == 1)).alias("ai_passages"))
    return percents(g)


def percents(g: DataFrame) -> DataFrame:
    """The shares of counts (doc_id, words, ai, human, ai_passages)."""
    one = lambda k: F.floor(F.col(k) * 1000 / F.col("words") + 0.5) / 10
    return g.select("doc_id", one("ai").alias("ai_percent"), F.round(F.greatest(F.lit(0.0), 100 - one("ai") - one("human")), 1).alias("uncertain_percent"), one("human").alias("human_percent"), "words", "ai_passages")


def share_label(percent: Column) -> Column:
    """Low shares are not given as a number."""
    return F.when((percent > 0) & (percent < 20), "*%").otherwise(F.concat(F.floor(percent + 0.5).cast("string"), F.lit("%")))
