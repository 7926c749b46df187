"""Queries on interval joins and keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkwell.functions import keys as K
from inkwell.functions import text as T
from inkwell.operators import intervals as I
from inkwell.operators import overlap as O
from inkwell.operators import preparing as P
from inkwell.operators import scoring as V
from inkwell.plans.citing import WORKS_SQL, works
from inkwell.plans.common import TEXTS, given, given_sql, sql_raw_words, sql_simple_sentences, sql_words, texts, values
from inkwell.plans.comparing import RUNS, _docs, w06
from inkwell.plans.detecting import BIAS, FITTED, fitted, scored, sql_scored


def _sentences(spark, sf_dir):
    return O.sentence_words(texts(spark, sf_dir)).where("words > 0").select("doc_id", "start", (F.col("start") + F.col("words")).alias("end"))


def _words(spark, sf_dir):
    """(words, the fitted model) where every row of texts has a doc_id of its own: windows are scored in the tasks that read the texts."""
    docs = texts(spark, sf_dir)
    t = F.coalesce("text", F.lit(""))
    lengths = F.transform(T.simple_sentences(t), T.word_count)
    return (V.by_words(docs, T.raw_words(t), lengths), 60, 40, V.vector(fitted(spark, sf_dir)), BIAS) if V.single(docs) else None


def _regions(spark, sf_dir):
    """Windows of 60 words with the probability that the fitted model gives each."""
    w = texts(spark, sf_dir).select("doc_id", T.raw_words(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", "w", F.posexplode(P.windows(F.col("w"), 60, 40)).alias("ix", "at"))
    w = w.select("doc_id", "ix", F.col("at.start").cast("long").alias("start"), F.col("at.end").cast("long").alias("end"), F.array_join(F.slice("w", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")), " ").alias("text"))
    return scored(w, fitted(spark, sf_dir)).select("doc_id", "start", "end", F.col("probability").alias("value"))


PARTS = f"""{TEXTS}, s0 AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM texts), s1 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM s0), s2 AS (SELECT doc_id, ix, len({sql_raw_words('s')}) AS w FROM s1),
s3 AS (SELECT doc_id, ix, w, sum(w) OVER (PARTITION BY doc_id ORDER BY ix)::BIGINT - w AS st FROM s2), sp AS (SELECT doc_id, st AS "start", st + w AS "end" FROM s3 WHERE w > 0),
{FITTED}, nr AS (SELECT doc_id, {sql_raw_words('text')} AS raws FROM texts), n AS (SELECT doc_id, len(raws) AS n FROM nr), wi AS (SELECT doc_id, raws, len(raws) AS n, unnest(range(greatest(ceil((len(raws) - 60) / 40.0)::INT, 0) + 1)) AS ix FROM nr WHERE len(raws) > 0),
wx AS (SELECT doc_id, ix, ix * 40 AS s, least(ix * 40 + 60, n) AS e, array_to_string(raws[ix * 40 + 1 : least(ix * 40 + 60, n)], ' ') AS text FROM wi), {sql_scored('wq', 'wx')}, rg AS (SELECT wx.doc_id, s, e, probability AS value FROM wx JOIN wq USING (doc_id, ix))"""


def j07(spark, sf_dir):
    if windows := _words(spark, sf_dir):
        return V.around_sentences(*windows, largest=False)
    return I.tightest(_sentences(spark, sf_dir), _regions(spark, sf_dir))


J07 = f"""WITH {PARTS}, j AS (SELECT sp.doc_id, "start", "end", value FROM sp JOIN rg ON rg.doc_id = sp.doc_id AND s <= "start" AND "end" <= e QUALIFY row_number() OVER (PARTITION BY sp.doc_id, "start", "end" ORDER BY e - s, s) = 1) SELECT sp.*, value FROM sp LEFT JOIN j USING (doc_id, "start", "end")"""


def j08(spark, sf_dir):
    if windows := _words(spark, sf_dir):
        return V.covering_means(*windows, points=np.arange(0, 201, 20))
    p = texts(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(200), F.lit(20))).alias("pos"))
    return I.averaged(p, _regions(spark, sf_dir)).withColumn("value", F.round("value", 6))


def j08_all(spark, sf_dir):
    """The mean at every word of each text; j08 has the first words in steps of 20."""
    if windows := _words(spark, sf_dir):
        return V.covering_means(*windows)
    n = F.size(T.raw_words(F.coalesce("text", F.lit(""))))
    p = texts(spark, sf_dir).where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return I.averaged(p, _regions(spark, sf_dir)).withColumn("value", F.round("value", 6))


def j09(spark, sf_dir):
    if windows := _words(spark, sf_dir):
        return V.around_sentences(*windows, largest=True)
    return I.largest_overlap(_sentences(spark, sf_dir), _regions(spark, sf_dir))


J09 = f"""WITH {PARTS}, j AS (SELECT sp.doc_id, "start", "end", value, s, least("end", e) - greatest("start", s) AS overlap FROM sp JOIN rg ON rg.doc_id = sp.doc_id AND least("end", e) > greatest("start", s)) SELECT doc_id, "start", "end", value, overlap FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, "start", "end" ORDER BY overlap DESC, s) = 1"""


def j10(spark, sf_dir):
    """Sentences that exact copies leave open, of documents that have copies."""
    spans = w06(spark, sf_dir)
    s = O.sentence_words(_docs(spark, sf_dir)).where("words > 0").select("doc_id", "start", (F.col("start") + F.col("words")).alias("end")).join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    return I.mostly_open(s, spans)


J10 = f"""WITH {RUNS}, s0 AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM documents), s1 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM s0), s2 AS (SELECT doc_id, ix, len({sql_words('s')}) AS w FROM s1), s3 AS (SELECT doc_id, w, sum(w) OVER (PARTITION BY doc_id ORDER BY ix)::BIGINT - w AS st FROM s2),
u AS (SELECT DISTINCT doc_id, pos FROM cov), c AS (SELECT s3.doc_id, st, w, count(pos) AS c FROM s3 LEFT JOIN u ON u.doc_id = s3.doc_id AND pos >= st AND pos < st + w WHERE w > 0 AND s3.doc_id IN (SELECT doc_id FROM u) GROUP BY ALL) SELECT doc_id, st AS "start", st + w AS "end" FROM c WHERE c < 0.5 * w"""


def f15(spark, sf_dir):
    return works(spark, sf_dir).select("work_id", K.same_work(F.concat(F.lit("[1234] "), "title")).alias("key"), K.clean_phrase(F.col("title"), 3).alias("phrase"), F.round(K.citation_prior(F.col("citations")), 6).alias("prior"))


F15 = rf"""WITH {WORKS_SQL} SELECT work_id, trim(regexp_replace(regexp_replace(lower('[1234] ' || title), '^\[[^\]]*\]\s*', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key, array_to_string(list_filter(string_split(regexp_replace(title, '[^\p{{L}}\p{{N}}''\-]+', ' ', 'g'), ' '), lambda x: x != '')[1:3], ' ') AS phrase, round(least(1, log10(1 + coalesce(citations, 0)) / 5), 6) AS prior FROM w"""
ADDRESSES = ((1, "10.1.2.3"), (2, "172.31.0.1"), (3, "172.32.0.1"), (4, "169.254.169.254"), (5, "169.254.1.1"), (6, "::ffff:127.0.0.1"), (7, "8.8.8.8"), (8, "300.1.1.1"), (9, "example.org"), (10, "100.127.255.255"), (11, "224.0.0.1"))
ADDRESSES_FROM = "SELECT event_id + 100, CASE event_id % 9 WHEN 0 THEN '10.' WHEN 1 THEN '172.' || CAST(event_id % 40 AS STRING) || '.' WHEN 2 THEN '192.168.' WHEN 3 THEN '::ffff:127.0.' WHEN 4 THEN '100.' WHEN 5 THEN '169.254.' ELSE CAST(event_id * 7 % 260 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.' END || CAST(event_id % 256 AS STRING) || CASE WHEN event_id % 9 IN (0, 4) THEN '.' || CAST(user_id % 256 AS STRING) ELSE '' END || CASE WHEN event_id % 50 = 0 THEN '' ELSE '.' || CAST(event_id % 251 AS STRING) END FROM {events}"


def m10(spark, sf_dir):
    return given(spark, sf_dir, ADDRESSES, "id long, a string", ADDRESSES_FROM).select("id", K.network_kind(F.col("a")).alias("kind"))


_CASES = " ".join(f"WHEN (n >> {32 - b}) = {K._number(a) >> (32 - b)} THEN '{k}'" for k, a, b in K.NETWORKS)
M10 = rf"""WITH a AS (SELECT id, regexp_replace(a, '(?i)^::ffff:', '') AS a FROM {given_sql(ADDRESSES, ADDRESSES_FROM, 'id', 'a')}), p AS (SELECT id, regexp_full_match(a, '[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}') AS ok, list_transform(string_split(a, '.'), lambda x: try_cast(x AS BIGINT)) AS p FROM a),
n AS (SELECT id, ok AND list_max(p) <= 255 AS ok, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] AS n FROM p) SELECT id, CASE WHEN ok THEN CASE {_CASES} ELSE 'public' END END AS kind FROM n"""
DATES = ((1, "2020,3,7"), (2, "1999"), (3, "2021,12"))
DATES_FROM = "SELECT event_id + 100, CAST(year(ts) AS STRING) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',' || CAST(month(ts) AS STRING) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',' || CAST(day(ts) AS STRING) END END FROM {events}"
LINKS = ((1, "10.48550/arXiv.2101.00001", None), (2, None, "https://arxiv.org/abs/1905.01234v2"), (3, None, "arXiv: 2203.12345"), (4, "10.1000/x", "https://x.org"))
LINKS_FROM = "SELECT page_id + 100, CASE WHEN page_id % 3 = 0 THEN '10.48550/ARXIV.2101.' || CAST(1000 + page_id AS STRING) WHEN page_id % 3 = 1 THEN '10.1000/' || CAST(page_id AS STRING) ELSE NULL END, CASE page_id % 4 WHEN 0 THEN 'https://arxiv.org/pdf/1905.' || CAST(10000 + page_id % 90000 AS STRING) || 'v1' WHEN 1 THEN 'see arXiv: 2203.' || CAST(1000 + page_id AS STRING) ELSE url END FROM {pages}"


def dt01(spark, sf_dir):
    return given(spark, sf_dir, DATES, "id long, d string", DATES_FROM).select("id", K.date_text(F.split("d", ",").cast("array<int>")).alias("date"))


def x03(spark, sf_dir):
    return given(spark, sf_dir, LINKS, "id long, doi string, url string", LINKS_FROM).select("id", K.arxiv_id(F.col("doi"), F.col("url")).alias("arxiv_id"))


X03 = rf"""SELECT id, coalesce(nullif(regexp_extract(coalesce(doi, ''), '(?i)10\.48550/arxiv\.([0-9]{{4}}\.[0-9]{{4,5}})', 1), ''), nullif(regexp_extract(coalesce(url, ''), '(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*)([0-9]{{4}}\.[0-9]{{4,5}})', 1), '')) AS arxiv_id FROM {given_sql(LINKS, LINKS_FROM, 'id', 'doi', 'url')}"""

QUERIES = {"j07_tightest_region": j07, "j08_covering_mean": j08, "j08_all_words_mean": j08_all, "j09_largest_overlap": j09, "j10_open_sentences": j10, "f15_work_keys": f15, "m10_network_kinds": m10, "dt01_dates": dt01, "x03_arxiv_ids": x03}
ORACLES = {
    "j07_tightest_region": J07, "j09_largest_overlap": J09, "j10_open_sentences": J10, "f15_work_keys": F15, "m10_network_kinds": M10, "x03_arxiv_ids": X03,
    "j08_covering_mean": f"WITH {PARTS}, p AS (SELECT doc_id, unnest(range(0, 201, 20)) AS pos FROM texts) SELECT p.doc_id, pos, round(avg(value), 6) AS value FROM p JOIN rg ON rg.doc_id = p.doc_id AND s <= pos AND pos < e GROUP BY ALL",
    "j08_all_words_mean": f"WITH {PARTS}, p AS (SELECT doc_id, unnest(range(n)) AS pos FROM n) SELECT p.doc_id, pos, round(avg(value), 6) AS value FROM p JOIN rg ON rg.doc_id = p.doc_id AND s <= pos AND pos < e GROUP BY ALL",
    "dt01_dates": f"SELECT id, array_to_string(list_transform(range(1, len(string_split(d, ',')) + 1), lambda i: CASE WHEN i = 1 THEN string_split(d, ',')[i] ELSE lpad(string_split(d, ',')[i], 2, '0') END), '-') AS date FROM {given_sql(DATES, DATES_FROM, 'id', 'd')}",
}
