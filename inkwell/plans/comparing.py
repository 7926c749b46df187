"""Queries on overlap: documents against benchmark passages, against each other and against themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T

from inkwell.operators import overlap as O
from inkwell.operators import translated as X
from inkwell.operators.tokens import ngrams, sentences
from inkwell.plans.common import SENTENCES, STOP, TEXTS, TOKENS, WORDS, given, given_sql, sql_normal, sql_raw_words, sql_simple_sentences, sql_words, texts, values
from inkwell.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return O.accepted(O.exact_runs(O.seed_hits(docs, _sources(spark, sf_dir))), docs)


RUNS = f"""
ws AS (SELECT doc_id, {sql_words('text')} AS words FROM documents),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM ws),
bws AS (SELECT item_id AS source_id, {sql_words('text')} AS words FROM benchmark),
btok AS (SELECT source_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM bws),
g AS (SELECT doc_id, pos, word || ' ' || w1 || ' ' || w2 AS gram FROM (SELECT *, lead(word) OVER w AS w1, lead(word, 2) OVER w AS w2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE w2 IS NOT NULL),
sg AS (SELECT source_id, pos AS spos, word || ' ' || w1 || ' ' || w2 AS gram FROM (SELECT *, lead(word) OVER w AS w1, lead(word, 2) OVER w AS w2 FROM btok WINDOW w AS (PARTITION BY source_id ORDER BY pos)) WHERE w2 IS NOT NULL),
hits AS (SELECT doc_id, source_id, pos, spos FROM g JOIN sg USING (gram)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, source_id, pos - spos ORDER BY pos) AS isl FROM hits),
run0 AS (SELECT doc_id, source_id, min(pos) AS "start", min(pos) + count(*) + 2 AS "end", min(spos) AS source_start, count(*) + 2 AS words FROM isl GROUP BY doc_id, source_id, pos - spos, isl),
runs AS (SELECT r.* FROM run0 r JOIN tok t ON t.doc_id = r.doc_id AND t.pos >= r."start" AND t.pos < r."end" WHERE r.words >= 6 GROUP BY ALL
         HAVING avg((t.word NOT IN {STOP})::INT) >= 0.4 AND count(DISTINCT t.word) >= 4),
cov AS (SELECT DISTINCT doc_id, source_id, unnest(range("start", "end")) AS pos FROM runs)"""


def p03(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return O.exact_runs(O.seed_hits(docs, _sources(spark, sf_dir)))


def p04(spark, sf_dir):
    return O.similarity(_docs(spark, sf_dir), _runs(spark, sf_dir))


def p05(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return O.bridged_runs(O.seed_hits(docs, _sources(spark, sf_dir)), docs)


#: One step of the joining of runs, and of the dropping of overlaps, for each pair of a document and a source.
BRIDGED = f"""{RUNS},
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_id ORDER BY "start", "end" DESC, source_start) AS n FROM run0),
br(doc_id, source_id, n, s, e, ss, w, done) AS (SELECT doc_id, source_id, n, "start", "end", source_start, words, []::STRUCT(s BIGINT, e BIGINT, ss BIGINT, w BIGINT)[] FROM ord WHERE n = 1
 UNION ALL SELECT o.doc_id, o.source_id, o.n, CASE WHEN k = 'new' THEN o."start" ELSE s END, CASE WHEN k = 'inside' THEN e ELSE o."end" END, CASE WHEN k = 'new' THEN o.source_start ELSE ss END,
  CASE k WHEN 'new' THEN o.words WHEN 'on' THEN w + o.words ELSE w END, CASE WHEN k = 'new' THEN list_append(done, {{'s': s, 'e': e, 'ss': ss, 'w': w}}) ELSE done END
 FROM (SELECT b.*, o AS o, CASE WHEN o."start" - e BETWEEN 0 AND 2 AND o.source_start - (ss + e - s) BETWEEN 0 AND 2 THEN 'on' WHEN o."start" < e AND o."end" <= e THEN 'inside' ELSE 'new' END AS k
  FROM br b JOIN ord o ON o.doc_id = b.doc_id AND o.source_id = b.source_id AND o.n = b.n + 1)),
brl AS (SELECT doc_id, source_id, unnest(list_append(done, {{'s': s, 'e': e, 'ss': ss, 'w': w}})) AS r FROM br QUALIFY row_number() OVER (PARTITION BY doc_id, source_id ORDER BY n DESC) = 1),
acc0 AS (SELECT doc_id, source_id, r.s AS s, r.e AS e, r.ss AS ss, r.w AS w FROM brl WHERE r.w >= 6),
acc AS (SELECT a.* FROM acc0 a JOIN tok t ON t.doc_id = a.doc_id AND t.pos >= s AND t.pos < e GROUP BY ALL HAVING avg((t.word NOT IN {STOP})::INT) >= 0.4 AND count(DISTINCT t.word) >= 4),
by_w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_id ORDER BY w DESC, s, e, ss) AS n FROM acc),
kept(doc_id, source_id, n, s, e, ss, w, ok, held) AS (SELECT doc_id, source_id, n, s, e, ss, w, true, range(s, e) FROM by_w WHERE n = 1
 UNION ALL SELECT doc_id, source_id, n, s, e, ss, w, ok, CASE WHEN ok THEN list_distinct(held || range(s, e)) ELSE held END
 FROM (SELECT b.*, k.held, 2 * len(list_intersect(k.held, range(b.s, b.e))) <= b.e - b.s AS ok FROM kept k JOIN by_w b ON b.doc_id = k.doc_id AND b.source_id = k.source_id AND b.n = k.n + 1)),
bridged AS (SELECT doc_id, source_id, s AS "start", e AS "end", ss AS source_start, w AS words FROM kept WHERE ok)"""


def a02(spark, sf_dir):
    return O.covered_positions(_runs(spark, sf_dir)).groupBy("doc_id", "source_id").agg(F.count("*").alias("words"))


def w06(spark, sf_dir):
    return O.credited_spans(_runs(spark, sf_dir), _sources(spark, sf_dir).select("source_id", F.lit(None).cast("int").alias("year")))


W06 = f"""WITH {RUNS},
p AS (SELECT DISTINCT doc_id, pos FROM cov), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM p),
sp AS (SELECT doc_id, min(pos) AS "start", max(pos) + 1 AS "end" FROM i GROUP BY doc_id, i),
who AS (SELECT s.doc_id, s."start", s."end", c.source_id, count(*) AS n FROM sp s JOIN cov c ON c.doc_id = s.doc_id AND c.pos >= s."start" AND c.pos < s."end" GROUP BY ALL)
"""


def p07(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return O.significant(_runs(spark, sf_dir), docs)


P07 = f"""WITH {RUNS},
ss AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM documents), s0 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM ss),
s1 AS (SELECT doc_id, ix, len({sql_raw_words('s')}) AS sw FROM s0),
s2 AS (SELECT *, sum(sw) OVER (PARTITION BY doc_id ORDER BY ix) - sw AS s_start FROM s1),
r AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, source_id) AS total FROM runs)
SELECT r.doc_id, r.source_id, r."start", r."end", r.source_start, r.words FROM r
WHERE total >= 15 OR words >= 10 OR (words >= 8 AND EXISTS (SELECT 1 FROM s2 WHERE s2.doc_id = r.doc_id AND r."start" >= s_start AND r."start" < s_start + sw AND r.words * 2 >= sw))"""


def a03(spark, sf_dir):
    """Credited words and share by source."""
    docs = _docs(spark, sf_dir)
    spans = w06(spark, sf_dir)
    n = docs.select("doc_id", F.greatest(T.word_count(F.col("text")), F.lit(1)).alias("n"))
    return spans.groupBy("doc_id", "source_id").agg(F.sum(F.col("end") - F.col("start")).alias("primary_words")).join(n, "doc_id").select("doc_id", "source_id", "primary_words", (F.floor(F.col("primary_words") * 1000 / F.col("n") + 0.5) / 10).alias("primary_percent"))


def j02(spark, sf_dir):
    return O.compare_papers(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").unionByName(spark.createDataFrame(list(PAPERS), "doc_id long, text string")))


PAPERS = (
    (-101, "The committee met on Tuesday to discuss the allocation of laboratory space among the four new research groups, and decided nothing."),
    (-102, "On a rainy day the committee met on Tuesday to discuss the allocation of laboratory space among the four visiting teams."),
    (-103, "Something else is written here by another author about other matters, which nobody has copied from anywhere at all."),
)
J02 = f"""WITH papers AS (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT * FROM {values(PAPERS, 'doc_id', 'text')}),
ws AS (SELECT doc_id, {sql_words('text')} AS words FROM papers),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM ws),
g AS (SELECT doc_id, pos, word || ' ' || w1 || ' ' || w2 AS gram FROM (SELECT *, lead(word) OVER w AS w1, lead(word, 2) OVER w AS w2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE w2 IS NOT NULL),
hits AS (SELECT x.doc_id AS a, y.doc_id AS b, x.pos, y.pos AS spos FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY a, b, pos - spos ORDER BY pos) AS isl FROM hits),
r0 AS (SELECT a, b, min(pos) AS s, min(spos) AS t, count(*) + 2 AS w FROM isl GROUP BY a, b, pos - spos, isl),
r AS (SELECT r0.* FROM r0 JOIN tok ON tok.doc_id = a AND tok.pos >= s AND tok.pos < s + w WHERE w >= 8 GROUP BY ALL HAVING avg((word NOT IN {STOP})::INT) >= 0.4 AND count(DISTINCT word) >= 4),
ca AS (SELECT a, b, count(DISTINCT p) AS n FROM (SELECT a, b, unnest(range(s, s + w)) AS p FROM r) GROUP BY a, b),
cb AS (SELECT a, b, count(DISTINCT p) AS n FROM (SELECT a, b, unnest(range(t, t + w)) AS p FROM r) GROUP BY a, b)
SELECT ca.a, ca.b, floor(ca.n * 1000 / greatest(len(wa.words), 1) + 0.5) / 10 AS a_percent, floor(cb.n * 1000 / greatest(len(wb.words), 1) + 0.5) / 10 AS b_percent, ca.n AS shared_words
FROM ca JOIN cb USING (a, b) JOIN ws wa ON wa.doc_id = a JOIN ws wb ON wb.doc_id = b"""


def u08(spark, sf_dir):
    return O.corpus_shared(_docs(spark, sf_dir))


U08 = f"""WITH ws AS (SELECT doc_id, {sql_words('text')} AS words FROM documents),
g AS (SELECT doc_id, p, array_to_string(words[p + 1 : p + 8], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(len(words) - 7)) AS p FROM ws WHERE len(words) >= 8)),
c AS (SELECT gram FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM g JOIN c USING (gram)) GROUP BY doc_id)
SELECT ws.doc_id, len(words) AS words, coalesce(n, 0) AS shared_words, floor(coalesce(n, 0) * 1000 / greatest(len(words), 1) + 0.5) / 10 AS shared_percent FROM ws LEFT JOIN cov USING (doc_id)"""


def p06(spark, sf_dir):
    return O.self_repeats(_docs(spark, sf_dir))


P06 = f"""WITH ws AS (SELECT doc_id, {sql_words('text')} AS words FROM documents),
g AS (SELECT doc_id, p AS pos, array_to_string(words[p + 1 : p + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(len(words) - 11)) AS p FROM ws WHERE len(words) >= 12)),
n AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS again FROM g),
k AS (SELECT *, again - pos AS k FROM n WHERE again - pos >= 12), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS i FROM k)
SELECT doc_id, min(pos) AS "start", min(again) AS again, least(count(*) + 11, k) AS words FROM i GROUP BY doc_id, k, i"""


def p12(spark, sf_dir):
    docs, items = texts(spark, sf_dir).unionByName(spark.createDataFrame([REWORDED[0]], "doc_id long, text string")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    src = sentences(items.unionByName(spark.createDataFrame([REWORDED[1]], "doc_id long, text string"))).withColumnRenamed("doc_id", "source_id")
    return O.paraphrases(sentences(docs), src)


REWORDED = (
    (-201, "The new technique increases accuracy on large image datasets and demonstrates significant results for medical experts."),
    (-202, "For medical experts, the novel method boosts accuracy on big image datasets, and shows important findings."),
)


def sql_stem(w: str) -> str:
    x = f"regexp_replace(regexp_replace({w}, 'ies$', 'y'), '(?:ing|edly|ed|es|s)$', '')"
    return f"CASE WHEN length({w}) <= 3 THEN {w} WHEN length({x}) >= 2 AND right({x}, 1) = left(right({x}, 2), 1) THEN left({x}, length({x}) - 1) ELSE {x} END"


def _concept_sql(name: str, rows: str) -> str:
    return f"""{name}0 AS (SELECT doc_id, ix, unnest({sql_words('sentence')}) AS word FROM {rows}),
{name} AS (SELECT DISTINCT doc_id, ix, coalesce(h.head, s.stem) AS concept FROM (SELECT doc_id, ix, {sql_stem('word')} AS stem FROM {name}0 WHERE length(word) >= 3 AND word NOT IN {STOP} AND NOT regexp_full_match(word, '[0-9]+')) s LEFT JOIN heads h ON h.stem = s.stem)"""


P12 = f"""WITH {TEXTS}, heads AS (SELECT * FROM {values(sorted(T.concept_heads().items()), 'stem', 'head')}),
at_ AS (SELECT * FROM texts UNION ALL SELECT * FROM {values([REWORDED[0]], 'doc_id', 'text')}), bt AS (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT * FROM {values([REWORDED[1]], 'doc_id', 'text')}),
asn AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS ix FROM (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM at_)),
bsn AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS ix FROM (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM bt)),
{_concept_sql('ac', 'asn')}, {_concept_sql('bc', 'bsn')},
an AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ix) AS n FROM ac), bn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ix) AS m FROM bc),
p AS (SELECT a.doc_id, a.ix, b.doc_id AS source_id, b.ix AS source_ix, (count(*) / n + count(*) / m) / 2 AS sim FROM an a JOIN bn b USING (concept) WHERE n >= 7 AND m >= 5 GROUP BY a.doc_id, a.ix, b.doc_id, b.ix, n, m HAVING count(*) >= 5 AND (count(*) / n + count(*) / m) / 2 >= 0.65)
SELECT doc_id, ix, source_id, source_ix, round(sim, 2) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, ix ORDER BY round(sim, 9) DESC, source_id, source_ix) = 1"""


def w11(spark, sf_dir):
    out = O.best_phrases(texts(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


W11 = f"""WITH {TOKENS},
w AS (SELECT doc_id, pos, CASE WHEN word IN {STOP} THEN 0 WHEN regexp_full_match(word, '[0-9]+') THEN 7 ELSE 35 + 5 * least(length(word), 14) END AS w, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
s AS (SELECT doc_id, pos, n, sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM w),
b AS (SELECT * FROM s WHERE pos + least(n, 10) <= n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos) = 1)
SELECT doc_id, pos AS "start", array_to_string(words[pos + 1 : pos + least(n, 10)], ' ') AS phrase, round(s / 35, 6) AS score FROM b JOIN ws USING (doc_id)"""


def p14(spark, sf_dir):
    return O.passages(texts(spark, sf_dir))


P14 = f"""WITH {SENTENCES},
r AS (SELECT doc_id, ix, {sql_raw_words('sentence')} AS raws FROM sen WHERE NOT regexp_matches(sentence, '(?i)^(?:table|figure|fig\\.|equation)(?:[^A-Za-z0-9_]|$)')),
t AS (SELECT doc_id, ix, unnest(raws) AS raw, generate_subscripts(raws, 1) AS p FROM r WHERE len(raws) >= 12), t2 AS (SELECT *, {sql_normal('raw')} AS word FROM t),
c AS (SELECT doc_id, ix, word, p, raw, word NOT IN {STOP} AND NOT regexp_full_match(raw, '[0-9]+') AS content FROM t2),
s AS (SELECT doc_id, ix, count(DISTINCT word) FILTER (content) + 0.5 * count(*) FILTER (content AND length(word) >= 9) + 2 * count(*) FILTER (content AND p > 1 AND regexp_matches(raw, '^[A-Z]') AND NOT regexp_full_match(raw, '[A-Z]+')) AS score FROM c GROUP BY doc_id, ix),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(ix) OVER (PARTITION BY doc_id) AS last FROM s)
SELECT doc_id, ix, score FROM n WHERE n <= 40 OR score >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN n <= 40 THEN ix ELSE floor(ix * 40 / (last + 1)) END ORDER BY score DESC, ix) = 1"""


def p11(spark, sf_dir):
    return O.quotations(texts(spark, sf_dir))


P11 = rf"""WITH {TEXTS}, q AS (SELECT doc_id, list_filter(regexp_extract_all(text, '["“][^"“”\n]{{1,1000}}?["”]'), lambda q: length(q) >= 40) AS qs FROM texts)
SELECT doc_id, unnest(list_transform(qs, lambda q: regexp_replace(q, '\s+', ' ', 'g'))) AS quotation, generate_subscripts(qs, 1) - 1 AS ix FROM q"""

SPANS = ((1, "a,b", 20), (1, "b", 7), (2, "c", 30), (3, "b,c", 4), (3, "c", 12))
LENGTHS = ((1, 100), (2, 120), (3, 90), (4, 0))
#: Lines of orders as spans of a document, their parts and suppliers as sources.
SPANS_FROM = "SELECT l_orderkey + 100, CASE l_suppkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'b,' || CAST(l_partkey AS STRING) ELSE CAST(l_partkey AS STRING) || ',' || CAST(l_suppkey AS STRING) END, CAST(floor(l_quantity) AS INT) FROM {lineitem}"
LENGTHS_FROM = "SELECT o_orderkey + 100, CAST(floor(o_totalprice % 900) AS INT) FROM {orders}"


def p19(spark, sf_dir):
    """A reader leaves out source b and matches under 5 words."""
    spans = given(spark, sf_dir, SPANS, "doc_id long, s string, words long", SPANS_FROM).select("doc_id", F.split("s", ",").alias("source_ids"), "words")
    return O.review(spans, given(spark, sf_dir, LENGTHS, "doc_id long, words long", LENGTHS_FROM), 5, ("b",))


P19 = f"""WITH sp AS (SELECT doc_id, list_filter(string_split(s, ','), lambda x: x != 'b') AS ids, words FROM {given_sql(SPANS, SPANS_FROM, 'doc_id', 's', 'words')}),
m AS (SELECT doc_id, sum(words) AS matched FROM sp WHERE len(ids) > 0 AND words >= 5 GROUP BY doc_id),
d AS (SELECT doc_id, d.words, coalesce(matched, 0) AS matched, floor(coalesce(matched, 0) * 1000 / greatest(d.words, 1) + 0.5) / 10 AS similarity FROM {given_sql(LENGTHS, LENGTHS_FROM, 'doc_id', 'words').replace(' v(', ' d(')} LEFT JOIN m USING (doc_id))
SELECT *, CASE WHEN similarity < 10 THEN 'low' WHEN similarity < 25 THEN 'moderate' ELSE 'high' END AS verdict FROM d"""


def l10(spark, sf_dir):
    """The sources that most documents share words with: candidates for a full-text look-up (top 8)."""
    n = O.covered_positions(_runs(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("words"), F.countDistinct("doc_id").alias("documents"))
    return n.orderBy(F.desc("words"), "source_id").limit(8)


def j11(spark, sf_dir):
    """Passages that are still open: under half of their words are covered by exact runs."""
    docs = _docs(spark, sf_dir)
    pos = O.covered_positions(_runs(spark, sf_dir)).select("doc_id", "pos").distinct()
    s = O.sentence_words(docs).where(F.col("words") >= 12)
    hit = s.join(pos, "doc_id").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("words"))).groupBy("doc_id", "ix").agg(F.count("*").alias("covered"))
    s = s.join(hit, ["doc_id", "ix"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return s.where(F.col("covered") * 2 < F.col("words")).groupBy("doc_id").agg(F.count("*").alias("open_passages"), F.sum("words").alias("open_words"))


J11 = f"""WITH {RUNS},
ss AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM documents), s0 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM ss),
s1 AS (SELECT doc_id, ix, len({sql_raw_words('s')}) AS sw FROM s0), s2 AS (SELECT *, sum(sw) OVER (PARTITION BY doc_id ORDER BY ix) - sw AS s_start FROM s1),
p AS (SELECT DISTINCT doc_id, pos FROM cov), h AS (SELECT s2.doc_id, ix, count(*) AS covered FROM s2 JOIN p ON p.doc_id = s2.doc_id AND pos >= s_start AND pos < s_start + sw GROUP BY ALL)
SELECT doc_id, count(*) AS open_passages, sum(sw)::BIGINT AS open_words FROM s2 LEFT JOIN h USING (doc_id, ix) WHERE sw >= 12 AND coalesce(covered, 0) * 2 < sw GROUP BY doc_id"""


def t06(spark, sf_dir):
    """The hundred commonest three-word phrases (a report)."""
    g = ngrams(texts(spark, sf_dir), 3).groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    return g.orderBy(F.desc("n"), "gram").limit(100)


T06 = f"""WITH {WORDS}, g AS (SELECT doc_id, array_to_string(words[p + 1 : p + 3], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(len(words) - 2)) AS p FROM ws WHERE len(words) >= 3))
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS documents FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 100"""

def _renderings(spark, sf_dir):
    """Sentences of documents in other languages, rendered in English: every fifth as the words of a benchmark item, backwards in
    every second of these (which no run of words can find), the others as a sentence of their own."""
    s = sentences(table(spark, sf_dir, "documents").where("lang != 'en'").select("doc_id", "text")).withColumn("k", F.col("doc_id") + F.col("ix"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_text"))
    s = s.join(F.broadcast(items), (F.col("k") % 5 == 0) & (F.col("k") % 40 == F.col("_item")), "left")
    back = F.array_join(F.reverse(F.split("_text", " ")), " ")
    own = F.concat(F.lit("This is plain sentence "), F.col("k").cast("string"), F.lit(" about other matters."))
    return s.select("doc_id", "ix", F.when(F.col("_text").isNull(), own).when(F.col("k") % 2 == 0, F.col("_text")).otherwise(back).alias("english"))


def p13(spark, sf_dir):
    return X.translated_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), _renderings(spark, sf_dir), _sources(spark, sf_dir))


P13 = f"""WITH RECURSIVE own AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS ix FROM (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM documents WHERE lang != 'en')),
ren AS (SELECT doc_id, ix, CASE WHEN b.text IS NULL THEN 'This is plain sentence ' || (doc_id + ix) || ' about other matters.' WHEN (doc_id + ix) % 2 = 0 THEN b.text ELSE array_to_string(list_reverse(string_split(b.text, ' ')), ' ') END AS english FROM own LEFT JOIN benchmark b ON (doc_id + ix) % 5 = 0 AND (doc_id + ix) % 40 = item_id),
sh AS (SELECT doc_id, string_agg(trim(english), ' ' ORDER BY ix) AS text FROM ren GROUP BY doc_id), {BRIDGED.replace('FROM documents)', 'FROM sh)')},
n AS (SELECT doc_id, ix, len({sql_raw_words('english')}) AS n FROM ren), pl AS (SELECT doc_id, ix, sum(n) OVER (PARTITION BY doc_id ORDER BY ix) - n AS f, sum(n) OVER (PARTITION BY doc_id ORDER BY ix) AS l FROM n),
ex AS (SELECT pl.doc_id, ix, source_id, 1.0::DOUBLE AS similarity FROM pl JOIN bridged b ON b.doc_id = pl.doc_id AND f < b."end" AND l > b."start" WHERE b."end" - b."start" >= 6),
heads AS (SELECT * FROM {values(sorted(T.concept_heads().items()), 'stem', 'head')}), asn AS (SELECT doc_id, ix, english AS sentence FROM ren), bsn AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS ix FROM (SELECT item_id AS doc_id, {sql_simple_sentences('text')} AS ss FROM benchmark)),
{_concept_sql('ac', 'asn')}, {_concept_sql('bc', 'bsn')},
an AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ix) AS n FROM ac), bn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ix) AS m FROM bc),
pa AS (SELECT a.doc_id, a.ix, b.doc_id AS source_id, b.ix AS source_ix, (count(*) / n + count(*) / m) / 2 AS sim FROM an a JOIN bn b USING (concept) WHERE n >= 7 AND m >= 5 GROUP BY a.doc_id, a.ix, b.doc_id, b.ix, n, m HAVING count(*) >= 5 AND (count(*) / n + count(*) / m) / 2 >= 0.6),
fr AS (SELECT doc_id, ix, source_id, round(sim, 2) AS similarity FROM pa QUALIFY row_number() OVER (PARTITION BY doc_id, ix ORDER BY round(sim, 9) DESC, source_id, source_ix) = 1),
bs AS (SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM fr) QUALIFY row_number() OVER (PARTITION BY doc_id, ix ORDER BY similarity DESC, source_id) = 1)
SELECT doc_id, ix, regexp_replace(own.text, '\\s+', ' ', 'g') AS text, english, source_id, similarity FROM bs JOIN own USING (doc_id, ix) JOIN ren USING (doc_id, ix)"""

QUERIES = {
    "p13_translated_copies": p13, "p04_overlap_similarity": p04, "p03_exact_runs": p03, "p05_bridged_runs": p05, "a02_source_words": a02, "a03_credited_words": a03, "w06_span_credit": w06, "p07_significant_runs": p07, "j02_pair_overlap": j02,
    "u08_corpus_shared": u08, "p06_self_repeats": p06, "p12_paraphrases": p12, "w11_best_phrase": w11, "p14_passages": p14, "p11_quotations": p11, "p19_review": p19, "l10_top_sources": l10, "j11_open_passages": j11, "t06_top_trigrams": t06,
}
ORACLES = {
    "p13_translated_copies": P13, "p03_exact_runs": f'WITH {RUNS} SELECT doc_id, source_id, "start", "end", source_start, words FROM run0',
    "p05_bridged_runs": f"WITH RECURSIVE {BRIDGED} SELECT * FROM bridged",
    "p04_overlap_similarity": f"""WITH {RUNS}, m AS (SELECT doc_id, count(DISTINCT pos) AS matched FROM cov GROUP BY doc_id),
b AS (SELECT doc_id, source_id FROM (SELECT doc_id, source_id, count(*) AS n FROM cov GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, source_id) = 1),
d AS (SELECT ws.doc_id, len(words) AS words, coalesce(matched, 0) AS matched, floor(coalesce(matched, 0) * 1000 / greatest(len(words), 1) + 0.5) / 10 AS similarity, source_id FROM ws LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT *, CASE WHEN similarity < 10 THEN 'low' WHEN similarity < 25 THEN 'moderate' ELSE 'high' END AS verdict FROM d""",
    "a02_source_words": f"WITH {RUNS} SELECT doc_id, source_id, count(*) AS words FROM cov GROUP BY ALL",
    "w06_span_credit": W06 + """SELECT doc_id, "start", "end", source_id, count(*) OVER (PARTITION BY doc_id, "start") AS n_sources FROM who QUALIFY row_number() OVER (PARTITION BY doc_id, "start" ORDER BY n DESC, source_id) = 1""",
    "a03_credited_words": W06 + """, c AS (SELECT doc_id, "start", "end", source_id FROM who QUALIFY row_number() OVER (PARTITION BY doc_id, "start" ORDER BY n DESC, source_id) = 1)
SELECT doc_id, source_id, sum("end" - "start")::BIGINT AS primary_words, floor(sum("end" - "start") * 1000 / any_value(greatest(len(words), 1)) + 0.5) / 10 AS primary_percent FROM c JOIN ws USING (doc_id) GROUP BY doc_id, source_id""",
    "p07_significant_runs": P07, "j02_pair_overlap": J02, "u08_corpus_shared": U08, "p06_self_repeats": P06, "p12_paraphrases": P12, "w11_best_phrase": W11, "p14_passages": P14, "p11_quotations": P11, "p19_review": P19, "j11_open_passages": J11, "t06_top_trigrams": T06,
    "l10_top_sources": f"WITH {RUNS} SELECT source_id, count(*) AS words, count(DISTINCT doc_id) AS documents FROM cov GROUP BY source_id ORDER BY words DESC, source_id LIMIT 8",
}
