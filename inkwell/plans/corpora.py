"""Queries on evaluation, samples and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import corpora as K
from inkwell.operators import detector as D
from inkwell.plans.common import given, given_sql, TEXTS, quote, texts, values
from inkwell.tables import table


def _scored(spark, sf_dir):
    """Labelled documents with a score that any document has: its share of distinct blank-separated words."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    score = F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))
    return d.select("doc_id", "source", F.col("quality").alias("label"), F.round(1 - score, 6).alias("score"))


SCORED = r"""sw AS (SELECT d.doc_id, d.source, l.quality AS label, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x != '') AS w FROM documents d JOIN labels l USING (doc_id)),
sc AS (SELECT doc_id, source, label, round(1 - len(list_distinct(w)) / greatest(len(w), 1), 6) AS score FROM sw)"""


def a23(spark, sf_dir):
    return K.scored_rates(_scored(spark, sf_dir).withColumn("flagged", F.col("score") >= 0.5), ["source"])


A23 = f"WITH {SCORED} SELECT label, source, count(*) AS n, floor(sum(round(score * 1000000)::BIGINT) / count(*) + 0.5) / 1000000.0::DOUBLE AS mean_score, round(avg((score >= 0.5)::INT), 6) AS flagged FROM sc GROUP BY GROUPING SETS ((label, source), (label))"


def a24(spark, sf_dir):
    return K.area_under_curve(_scored(spark, sf_dir))


A24 = f"""WITH {SCORED}, r AS (SELECT label, round(score, 4) AS s FROM sc), k AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mid FROM r), n AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(CASE WHEN label = 1 THEN mid END) AS s FROM k)
SELECT p::BIGINT AS n_positive, n::BIGINT AS n_negative, round((s - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM n"""


def _indexed(spark, sf_dir):
    return _scored(spark, sf_dir).select(F.col("doc_id").alias("ix"), "label", "score")


def a25(spark, sf_dir):
    return K.calibrate(_indexed(spark, sf_dir), 0.05)


A25 = f"""WITH {SCORED}, t AS (SELECT quantile_cont(round(score, 4), 0.95) AS t FROM sc WHERE label = 0 AND doc_id % 2 = 0)
SELECT round(t, 6) AS threshold, round(avg(CASE WHEN label = 0 AND doc_id % 2 = 1 THEN (score >= t)::INT END), 6) AS false_positive_rate, round(avg(CASE WHEN label = 1 THEN (score >= t)::INT END), 6) AS detection_rate FROM sc, t GROUP BY t"""


def a31(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("score") >= 0.5).alias("hits"), F.count("*").alias("n"))
    lo, hi = K.wilson(F.col("hits"), F.col("n"))
    return g.select("source", "hits", "n", lo.alias("low"), hi.alias("high"))


Z = "1.959964::DOUBLE"
A31 = f"""WITH {SCORED}, g AS (SELECT source, count(*) FILTER (score >= 0.5) AS hits, count(*) AS n FROM sc GROUP BY source), h AS (SELECT *, hits / n AS p, 1 + {Z} * {Z} / n AS d FROM g)
SELECT source, hits, n, round((p + {Z} * {Z} / (2 * n)) / d - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / d, 6) AS low, round((p + {Z} * {Z} / (2 * n)) / d + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / d, 6) AS high FROM h"""


def u07(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", K.md5_digit(F.col("doc_id").cast("string")).alias("digit"))
    return d.withColumn("split", F.when(F.col("digit") < 3, "test").otherwise("train"))


DIGIT = "((6 * list_sum(list_transform(range(1, 32), lambda i: ('0x' || substr(md5(k), i, 1))::INT)) + ('0x' || substr(md5(k), 32, 1))::INT) % 10)::INT"
U07 = f"WITH d AS (SELECT doc_id, doc_id::VARCHAR AS k FROM documents), g AS (SELECT doc_id, {DIGIT} AS digit FROM d) SELECT *, CASE WHEN digit < 3 THEN 'test' ELSE 'train' END AS split FROM g"


def w15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return K.stratified_sample(d, ["lang", "source"], 20, "doc_id")


W15 = "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT, doc_id) <= 20"


def k01(spark, sf_dir):
    t = K.truncate(F.coalesce("text", F.lit("")), 50)
    return texts(spark, sf_dir).select("doc_id", F.md5(t.cast("binary")).alias("md5"), F.length(t).alias("chars"))


K01 = rf"WITH {TEXTS}, t AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w != '')[1:50], ' ') AS t FROM texts) SELECT doc_id, md5(t) AS md5, length(t) AS chars FROM t"


def k04(spark, sf_dir):
    return K.chunks(texts(spark, sf_dir), least=60, most=380).select("doc_id", "ix", "words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def k08(spark, sf_dir):
    """Detection by source at the calibrated threshold."""
    s = _scored(spark, sf_dir)
    t = K.calibrate(s.select(F.col("doc_id").alias("ix"), "label", "score"), 0.05).select("threshold")
    return s.join(F.broadcast(t)).groupBy("label", "source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= F.col("threshold")).cast("int")), 6).alias("flagged"))  # t: one row


K08 = f"WITH {SCORED}, t AS (SELECT round(quantile_cont(round(score, 4), 0.95), 6) AS t FROM sc WHERE label = 0 AND doc_id % 2 = 0) SELECT label, source, count(*) AS n, round(avg((score >= t)::INT), 6) AS flagged FROM sc, t GROUP BY label, source"


def k10(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    w = v.where("x is not null and not isnan(x)").select((F.col("vec_id") * 64 + F.col("i")).alias("h"), F.col("x").cast("double").alias("w"))
    return K.quantised(w).withColumn("scale", F.round("scale", 9))


K10 = "WITH w AS (SELECT vec_id * 64 + i AS h, x::DOUBLE AS w FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE x IS NOT NULL AND NOT isnan(x)), s AS (SELECT max(abs(w)) / 127 AS scale FROM w) SELECT h, least(127, greatest(-127, round(w / scale)))::INT AS q, round(scale, 9) AS scale FROM w, s"

REPLIES = (
    (-1, "Here is the paragraph:\n" + "Clear words follow one another here. " * 12), (-2, "I can't help with that request. " * 12), (-3, "Short reply."), (-4, "“" + "A quoted paragraph of many words goes on and on. " * 8 + "”"), (-5, "word " * 70), (-6, "As asked, here's the revised text. " + "More words follow. " * 30),
)


def k11(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text").unionByName(spark.createDataFrame([(i, 0, t) for i, t in REPLIES], "conv_id long, turn long, text string"))
    t = K.usable_reply(F.col("text"))
    return c.select("conv_id", "turn", t.alias("t")).where("t is not null").select("conv_id", "turn", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


K11 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM {values([(i, 0, t) for i, t in REPLIES], 'conv_id', 'turn', 'text')}), a AS (SELECT conv_id, turn, regexp_replace(text, '^[\s"“”]+|[\s"“”]+$', '', 'g') AS t FROM c),
b AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, {quote(K.PREAMBLE)}) THEN trim(regexp_replace(t, '(?s)^[^\n]*(?:\n|$)', '')) ELSE t END AS t FROM a), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x != '') AS w FROM b),
g AS (SELECT conv_id, turn, array_to_string(w[1:400], ' ') AS t FROM w WHERE NOT regexp_matches(t, {quote(K.REFUSAL)}) AND NOT regexp_matches(t, {quote(K.CHATTER)}) AND len(w) >= 60 AND regexp_matches(t, '[.!?)\]"”]$')) SELECT conv_id, turn, length(t) AS chars, md5(t) AS md5 FROM g"""
MODELS, MIX = ["alpha", "beta", "gamma"], {"write": 0.2, "polish": 0.35, "paraphrase": 0.15, "humanise": 0.15, "translate": 0.15}


def k12(spark, sf_dir):
    return K.job_plan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), MODELS, 20, MIX)


def _share(k: str) -> str:
    return f"('0x' || substr(md5({k}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


K12 = f"""WITH u AS (SELECT doc_id AS id, {_share("'13:' || doc_id")} AS u, {_share("'kind:13:' || doc_id")} AS v FROM documents), f AS (SELECT *, row_number() OVER (ORDER BY u, id) - 1 AS n FROM u ORDER BY u, id LIMIT 60)
SELECT id, ['alpha', 'beta', 'gamma'][(n % 3 + 1)::INT] AS model, CASE WHEN v < 0.2 THEN 'write' WHEN v < {0.2 + 0.35} THEN 'polish' WHEN v < {0.2 + 0.35 + 0.15} THEN 'paraphrase' WHEN v < {0.2 + 0.35 + 0.15 + 0.15} THEN 'humanise' ELSE 'translate' END AS kind, floor(n / 3)::BIGINT AS turn FROM f"""
LEVELS = ((1, "degree-based", "major", None), (2, "degree-based", "minor", None), (3, "degree-based", "extreme_minor", None), (4, "percent", None, 35), (5, "percent", None, 20), (6, "percent", None, 5))
LEVELS_FROM = "SELECT doc_id + 100, CASE WHEN doc_id % 2 = 0 THEN 'degree-based' ELSE 'percent' END, CASE WHEN doc_id % 2 = 1 THEN NULL WHEN doc_id % 8 = 0 THEN 'major' WHEN doc_id % 8 = 2 THEN 'slight_major' WHEN doc_id % 8 = 4 THEN 'minor' ELSE 'extreme_minor' END, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE CAST(n_chars % 60 AS INT) END FROM {documents}"


def k13(spark, sf_dir):
    d = given(spark, sf_dir, LEVELS, "id long, kind string, degree string, percent int", LEVELS_FROM)
    return d.select("id", K.polish_label(F.col("kind"), F.col("degree"), F.col("percent")).alias("label"))


K13 = f"SELECT id, CASE WHEN kind = 'degree-based' THEN CASE WHEN degree IN ('major', 'slight_major') THEN 'ai' WHEN degree = 'extreme_minor' THEN 'human' END WHEN percent >= 35 THEN 'ai' WHEN percent <= 5 THEN 'human' END AS label FROM {given_sql(LEVELS, LEVELS_FROM, 'id', 'kind', 'degree', 'percent')}"
HOSTS = ((-401, "However, the results show that our new method can improve the main analysis of several large data sets in this study today. A short one. Another sentence that has enough words in it to count as good for the purposes of this small test case here."),)


def k14(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").unionByName(spark.createDataFrame(list(HOSTS), "doc_id long, text string"))
    s = K.good_sentences(d)
    return s.select("doc_id", "ix", K.edited(F.col("sentence"), F.col("ix")).alias("edited"), K.reworded(F.col("sentence")).alias("reworded"))


POLISHED, ORIGINALS = ((1, "a", "the red fox jumps over lazy dogs"), (2, "a", "weather models are improving fast"), (3, "b", "the red fox jumps")), ((10, "a", "a red fox jumps over dogs"), (11, "a", "weather models improve"), (12, "b", "nothing in common red"), (13, "b", "the fox"))


#: Benchmark items as polished texts, documents as what they may come from.
POLISHED_FROM, ORIGINALS_FROM = "SELECT item_id + 100, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END, text FROM {benchmark}", "SELECT doc_id + 100, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END, text FROM {documents} WHERE text IS NOT NULL"


def j22(spark, sf_dir):
    kind = "id long, domain string, text string"
    return K.best_originals(given(spark, sf_dir, POLISHED, kind, POLISHED_FROM), given(spark, sf_dir, ORIGINALS, kind, ORIGINALS_FROM))


J22 = f"""WITH a AS (SELECT id, domain, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {given_sql(POLISHED, POLISHED_FROM, 'id', 'domain', 'text')}), b AS (SELECT id AS original, domain, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {given_sql(ORIGINALS, ORIGINALS_FROM, 'id', 'domain', 'text')}),
j AS (SELECT id, original, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS n FROM a JOIN b USING (domain)) SELECT id, original, round(c / (n - c), 6) AS similarity FROM j WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c / (n - c) DESC, original DESC) = 1"""


def k05(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi").select("doc_id", "text")
    return K.libsvm_lines(D.hashed_features(d), labels).select("doc_id", F.length("line").alias("chars"), F.substring_index("line", " ", 1).alias("label"))


def k15(spark, sf_dir):
    """How many test cases of each kind the overlap search finds in their own source."""
    from inkwell.operators import overlap as O

    src = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text")
    s = K.good_sentences(src.withColumnRenamed("source_id", "doc_id")).groupBy("doc_id").agg(F.min_by("sentence", "ix").alias("sentence"))
    cases = s.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("verbatim"), F.lit("edited")), F.array("sentence", K.edited(F.col("sentence"), F.lit(0))))).alias("kind", "text"))
    cases = cases.withColumn("id", F.col("doc_id") * 2 + F.when(F.col("kind") == "edited", 1).otherwise(0))
    docs = cases.select(F.col("id").alias("doc_id"), "text")
    runs = O.accepted(O.exact_runs(O.seed_hits(docs, src)), docs).select(F.col("doc_id").alias("id"), "source_id").distinct()
    j = cases.join(runs, "id", "left").groupBy("kind", "id", "doc_id").agg(F.count("source_id").alias("found"), F.max((F.col("source_id") == F.col("doc_id")).cast("int")).alias("right"))
    return j.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if(F.col("found") > 0).alias("found"), F.coalesce(F.sum("right"), F.lit(0)).alias("right_source"))


QUERIES = {
    "a23_eval_summary": a23, "a24_auroc": a24, "a25_calibration": a25, "a31_wilson": a31, "u07_md5_split": u07, "w15_stratified_sample": w15, "k01_truncated": k01, "k04_chunks": k04, "k05_libsvm": k05, "k08_breakdown": k08, "k10_quantised": k10, "k11_usable_replies": k11, "k12_job_plan": k12, "k13_polish_labels": k13,
    "k14_test_cases": k14, "k15_case_tally": k15, "j22_best_originals": j22,
}
ORACLES = {
    "a23_eval_summary": A23, "a24_auroc": A24, "a25_calibration": A25, "a31_wilson": A31, "u07_md5_split": U07, "w15_stratified_sample": W15, "k01_truncated": K01, "k08_breakdown": K08, "k10_quantised": K10, "k11_usable_replies": K11, "k12_job_plan": K12, "k13_polish_labels": K13, "j22_best_originals": J22,
}
