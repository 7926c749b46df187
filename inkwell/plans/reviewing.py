"""Queries on reviews of documents: cited copies, excerpts, unions, warnings, and the cutting of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import citations as C
from inkwell.operators import overlap as O
from inkwell.operators import reviewing as R
from inkwell.plans.common import TEXTS, quote, sql_raw_words, sql_simple_sentences, texts, values
from inkwell.plans.comparing import RUNS, W06
from inkwell.plans.reporting import A22, a22
from inkwell.tables import table

#: What documents have none of: copies with and without a citation, author blocks, headings, tags.
COPIES = (
    (-301, "The weather was fine. As others found, the quiet harbour town rebuilt its wooden lighthouse after the great winter storm of that year (Smith, 2020). Nobody minded."),
    (-302, "We note that the quiet harbour town rebuilt its wooden lighthouse after the great winter storm of that year. It was long ago [3]."),
    (-303, 'Jones and Lee (2019) say that every spring the old ferry carried apples and lamp oil across the narrow sound to the market. "A quotation that is long enough to be counted as one here" it says.'),
    (-304, "Too short."),
)
ORIGINALS = ((-401, "In those days the quiet harbour town rebuilt its wooden lighthouse after the great winter storm of that year, and every spring the old ferry carried apples and lamp oil across the narrow sound to the market, or so they say."),)
PAPERS = (
    (-311, "On the Growth of Mosses\nAnn Smith, Bo Lee\nDepartment of Botany, Some University\n\nAbstract\nMosses grow in many places and we measured how fast they do so in the course of two wet years in the north.\n\nREFERENCES\n\n[1] A long reference that has more than twelve words and ends as if it were a sentence here."),
    (-312, "A Title\nabstract: short"), (-313, "No break abstract"),
    (-314, "Title\n" + "This line is far too long to be part of any block of authors since it goes on and on.\n" + "Summary\nText."),
    (-315, "Heading\n \n\n  This short paragraph has just over twelve words and it ends like one.  \n\nA fragment of twelve or more words that never ends in a mark of any sort at all"),
    (-316, "The/at Fulton/np-tl County/nn-tl said/vbd ``/`` no/at evidence/nn ''/'' ./."),
)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(list(COPIES), "doc_id long, text string"))


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text").unionByName(spark.createDataFrame(list(ORIGINALS), "source_id long, text string"))


def _papers(spark, sf_dir):
    return texts(spark, sf_dir).unionByName(spark.createDataFrame(list(PAPERS), "doc_id long, text string"))


def _spans(spark, sf_dir):
    docs, sources = _docs(spark, sf_dir), _sources(spark, sf_dir)
    runs = O.accepted(O.exact_runs(O.seed_hits(docs, sources)), docs)
    return docs, sources, runs, O.credited_spans(runs, sources.select("source_id", F.lit(None).cast("int").alias("year")))


BOTH = f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(COPIES, 'doc_id', 'text')}), srcs AS (SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM {values(ORIGINALS, 'item_id', 'text')})"
SPANS = W06.replace(RUNS, RUNS.replace("FROM documents)", "FROM docs)").replace("FROM benchmark)", "FROM srcs)")).replace("WITH ", f"WITH {BOTH}, ", 1) + """, sps AS (SELECT doc_id, "start", "end", source_id FROM who QUALIFY row_number() OVER (PARTITION BY doc_id, "start" ORDER BY n DESC, source_id) = 1)"""
CITED = f"""{SPANS},
c0 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM docs)),
c1 AS (SELECT doc_id, ix, len({sql_raw_words('s')}) AS w, coalesce(nullif(regexp_extract(s, {quote('(' + C.NUMERIC + ')')}, 1), ''), '(' || list_filter(regexp_extract_all(s, {quote(C.PARENTHESES)}, 1), lambda x: regexp_matches(x, '(?:19|20)[0-9]{{2}}') AND regexp_matches(x, '\\p{{Lu}}\\p{{L}}'))[1] || ')', nullif(regexp_extract(s, {quote('(' + C.NARRATIVE + ')')}, 1), '')) AS citation FROM c0),
c2 AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ix) - w AS st FROM c1),
csp AS (SELECT s.doc_id, s."start", s."end", s.source_id, arg_min(citation, ix) AS citation FROM sps s LEFT JOIN c2 ON c2.doc_id = s.doc_id AND citation IS NOT NULL AND st < s."end" AND st + w > s."start" GROUP BY ALL)"""


def p10(spark, sf_dir):
    docs, _, _, spans = _spans(spark, sf_dir)
    return R.cited(spans, docs).select("doc_id", "start", "end", "source_id", "citation")


def p01(spark, sf_dir):
    """The whole check of each document: score, copies with and without a citation, quotations, warnings."""
    docs, _, runs, spans = _spans(spark, sf_dir)
    return R.report(O.similarity(docs, runs).drop("source_id"), R.cited(spans, docs), O.quotations(docs))


P01 = f"""{CITED}, m AS (SELECT doc_id, count(DISTINCT pos) AS matched FROM cov GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(sum("end" - "start") FILTER (citation IS NOT NULL), 0)::BIGINT AS copied_cited, coalesce(sum("end" - "start") FILTER (citation IS NULL), 0)::BIGINT AS copied_uncited FROM csp GROUP BY doc_id),
q AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '["“][^"“”\n]{{1,1000}}?["”]'), lambda q: length(q) >= 40)) AS quotations FROM docs),
d AS (SELECT ws.doc_id, coalesce(len(words), 0) AS words, coalesce(matched, 0) AS matched, floor(coalesce(matched, 0) * 1000 / greatest(coalesce(len(words), 0), 1) + 0.5) / 10 AS similarity, coalesce(copied_cited, 0) AS copied_cited, coalesce(copied_uncited, 0) AS copied_uncited, coalesce(quotations, 0) AS quotations
 FROM ws LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT *, CASE WHEN similarity < 10 THEN 'low' WHEN similarity < 25 THEN 'moderate' ELSE 'high' END AS verdict,
 concat_ws(' ', CASE WHEN words < 8 THEN 'The text is too short for a meaningful check.' END, CASE WHEN copied_uncited > 0 THEN copied_uncited || ' words are copied without a citation.' END) AS warnings FROM d"""


def p09(spark, sf_dir):
    _, sources, runs, spans = _spans(spark, sf_dir)
    return R.excerpts(spans, runs, sources)


P09 = f"""{SPANS}, b AS (SELECT s.doc_id, s."start", s."end", s.source_id, r."start" AS rs, r."end" AS re, source_start AS ss FROM sps s JOIN runs r ON r.doc_id = s.doc_id AND r.source_id = s.source_id AND least(r."end", s."end") > greatest(r."start", s."start")
 QUALIFY row_number() OVER (PARTITION BY s.doc_id, s."start" ORDER BY least(r."end", s."end") - greatest(r."start", s."start") DESC, r."start", source_start) = 1),
x AS (SELECT b.*, {sql_raw_words('text')} AS raws, regexp_split_to_array(text, {quote(T.WORD)}) AS gaps FROM b JOIN srcs ON item_id = source_id),
y AS (SELECT *, least(ss + greatest(0, "start" - rs), len(raws) - 1) AS a FROM x), z AS (SELECT *, least(a + greatest(1, least(re, "end") - greatest(rs, "start")) - 1, len(raws) - 1) AS z FROM y),
f AS (SELECT *, greatest(0, a - 15) AS f, least(len(raws) - 1, z + 15) AS t FROM z)
SELECT doc_id, "start", "end", source_id, regexp_replace(CASE WHEN f > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(f, t + 1), lambda i: CASE WHEN i > f THEN gaps[i + 1] ELSE '' END || raws[i + 1]), '') || CASE WHEN t < len(raws) - 1 THEN '…' ELSE '' END, '\\s+', ' ', 'g') AS excerpt FROM f"""


def p22(spark, sf_dir):
    return R.provider_warnings(a22(spark, sf_dir))


P22 = f"SELECT provider, provider || CASE WHEN failures = queries THEN ' could not be searched this time, so it contributed nothing.' ELSE ' could not be searched for ' || failures || ' of ' || queries || ' passages.' END AS warning FROM ({A22}) WHERE failures > 0"


def u02(spark, sf_dir):
    """Benchmark items as own works, documents as the library, pages as what a provider found; the first of an id stays."""
    part = lambda name, key, text, kind: table(spark, sf_dir, name).select(F.col(key).alias("source_id"), F.lit(kind).alias("kind"), F.col(text).alias("text"))
    out = R.first_by_id(part("benchmark", "item_id", "text", "own"), part("documents", "doc_id", "text", "library"), part("pages", "page_id", "html", "provider"))
    return out.select("source_id", "kind", F.length("text").alias("chars"))


U02 = """WITH u AS (SELECT item_id AS source_id, 0 AS p, 'own' AS kind, text FROM benchmark UNION ALL SELECT doc_id, 1, 'library', text FROM documents UNION ALL SELECT page_id, 2, 'provider', html FROM pages)
SELECT source_id, kind, length(text) AS chars FROM u QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY p, text) = 1"""


def p20(spark, sf_dir):
    """Pages as sources by address; the author's own are the addresses of the host with most pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("doi"), F.lit("web").alias("kind"))
    host = F.regexp_extract("doi", "^https?://([^/]+)", 1)
    most = pages.groupBy(host.alias("host")).count().orderBy(F.desc("count"), "host").limit(1)
    return R.own_works(pages, pages.withColumn("host", host).join(F.broadcast(most), "host").select(F.upper("doi").alias("doi")))


P20 = "SELECT page_id, url AS doi, CASE WHEN lower(url) IN (SELECT lower(url) FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) = (SELECT h FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)) THEN 'own' ELSE 'web' END AS kind FROM pages"


def p17(spark, sf_dir):
    """Benchmark items known by their first 14 words; in full, even ones are whole and odd ones turn out to be a document of that number."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    short = items.select(F.col("item_id").alias("source_id"), F.array_join(F.slice(F.split("text", " "), 1, 14), " ").alias("text"))
    full = items.where("item_id % 2 = 0").select(F.col("item_id").alias("source_id"), "text").unionByName(docs.join(F.broadcast(items.where("item_id % 2 = 1").select("item_id")), F.col("doc_id") == F.col("item_id")).select(F.col("item_id").alias("source_id"), "text"))
    others = docs.join(F.broadcast(items.select("item_id")), F.col("doc_id") == F.col("item_id"), "left_anti")
    used, runs = R.upgraded_runs(others, short, full, lambda d, s: O.accepted(O.exact_runs(O.seed_hits(d, s)), d))
    n = runs.groupBy("source_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("words").alias("words"))
    return used.join(n, "source_id").select("source_id", "upgraded", F.length("text").alias("chars"), "documents", "words")


P17 = f"""WITH others AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)), s0 AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:14], ' ') AS text FROM benchmark),
f0 AS (SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1 AND doc_id IN (SELECT item_id FROM benchmark)),
both0 AS (SELECT s0.item_id * 2 AS item_id, s0.text FROM s0 UNION ALL SELECT s0.item_id * 2 + 1, f0.text FROM s0 JOIN f0 USING (item_id) WHERE length(f0.text) > length(s0.text)), {RUNS.replace('FROM documents)', 'FROM others)').replace('FROM benchmark)', 'FROM both0)')},
c AS (SELECT source_id // 2 AS item_id, source_id % 2 AS is_full, count(DISTINCT doc_id) AS documents, sum(words)::BIGINT AS words FROM runs GROUP BY ALL), o AS (SELECT * FROM c WHERE is_full = 0), n AS (SELECT * FROM c WHERE is_full = 1)
SELECT o.item_id AS source_id, n.item_id IS NOT NULL AS upgraded, CASE WHEN n.item_id IS NOT NULL THEN length(f0.text) ELSE length(s0.text) END AS chars, coalesce(n.documents, o.documents) AS documents, coalesce(n.words, o.words) AS words FROM o JOIN s0 USING (item_id) LEFT JOIN f0 USING (item_id) LEFT JOIN n USING (item_id)"""


def g04(spark, sf_dir):
    """Each text's middle, and one range past its end that must fall out."""
    d = texts(spark, sf_dir)
    n = F.length(F.coalesce("text", F.lit("")))
    at = F.explode(F.array(*[F.struct((F.floor(n / 2) + k).alias("start"), (F.floor(n / 2) + e).alias("end")) for k, e in ((0, 5), (3, 3))], F.struct(n.cast("long").alias("start"), (n + 4).cast("long").alias("end"))))
    return R.hidden(d.select("doc_id", at.alias("r")).select("doc_id", "r.start", "r.end"), d)


G04 = f"""WITH {TEXTS}, n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM texts) SELECT doc_id, n // 2 AS "start", n // 2 + 5 AS "end", substring(t, (n // 2 + 1)::INT, 5) AS text, 5 AS "count" FROM n WHERE n // 2 + 5 <= n"""


def t11(spark, sf_dir):
    return _papers(spark, sf_dir).select("doc_id", R.front_matter(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.start", "r.end")


PAPERS_SQL = f"{TEXTS}, papers AS (SELECT * FROM texts UNION ALL SELECT * FROM {values(PAPERS, 'doc_id', 'text')})"
T11 = f"""WITH {PAPERS_SQL}, h AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), 6000) AS h FROM papers), b AS (SELECT *, length(regexp_split_to_array(h, {quote(R.ABSTRACT)})[1]) AS n, strpos(t, chr(10)) - 1 AS st FROM h),
e AS (SELECT *, CASE WHEN n = length(h) THEN -1 ELSE n + (substring(h, n + 1, 1) = chr(10))::INT END AS en, list_filter(list_transform(string_split(CASE WHEN n > st THEN substring(t, st + 1, n - st) ELSE '' END, chr(10)), lambda x: trim(x)), lambda x: x != '') AS ls FROM b),
g AS (SELECT *, en >= 0 AND st >= 0 AND st < n AND len(ls) > 0 AND (len(list_filter(ls, lambda x: regexp_matches(x, {quote(R.AFFILIATION)}))) > 0 OR len(list_filter(ls, lambda x: len(regexp_split_to_array(x, '\\s+')) > 12)) = 0) AS good FROM e)
SELECT doc_id, CASE WHEN good THEN st END AS "start", CASE WHEN good THEN en END AS "end" FROM g"""


def t17(spark, sf_dir):
    return R.prose(_papers(spark, sf_dir))


T17 = f"""WITH {PAPERS_SQL}, p0 AS (SELECT doc_id, coalesce(text, '') AS t FROM papers), p1 AS (SELECT doc_id, length(t) AS n, regexp_split_to_array(t, {quote(R.BLANK_LINE)}) AS ps, regexp_extract_all(t, {quote(R.BLANK_LINE)}) AS ss FROM p0),
p2 AS (SELECT doc_id, n, unnest(ps) AS p, generate_subscripts(ps, 1) AS ix, ss FROM p1), p3 AS (SELECT doc_id, n, ix, p, coalesce(ss[ix], '') AS s FROM p2),
p4 AS (SELECT *, sum(length(p) + length(s)) OVER (PARTITION BY doc_id ORDER BY ix) - length(s) - length(regexp_replace(p, '^\\s+', '')) AS st, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS b FROM p3),
p5 AS (SELECT *, min(ix) FILTER (regexp_matches(b, {quote(R.LIST_HEADING)})) OVER (PARTITION BY doc_id) AS stop, len(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}]+')) AS w FROM p4),
ok AS (SELECT doc_id, st::BIGINT AS "start", (st + length(b))::BIGINT AS "end" FROM p5 WHERE ix < coalesce(stop, 1 << 30) AND (w >= 30 OR (w >= 12 AND regexp_matches(b, {quote(R.SENTENCE_END)}))))
SELECT * FROM ok UNION ALL SELECT doc_id, 0, length(t) FROM p0 WHERE doc_id NOT IN (SELECT doc_id FROM ok)"""


def t07(spark, sf_dir):
    return R.chunks(texts(spark, sf_dir), 600)


T07 = f"""WITH {TEXTS}, s AS (SELECT doc_id, ss FROM (SELECT doc_id, {sql_simple_sentences("coalesce(text, '')")} AS ss FROM texts) WHERE len(ss) > 0),
l AS (SELECT doc_id, ss, list_transform(range(1, len(ss) + 1), lambda i: {{'starts': [i], 'size': length(ss[i]), 'at': i}}) AS ls FROM s),
r AS (SELECT doc_id, ss, list_reduce(ls, lambda a, x: {{'starts': CASE WHEN a.size + 1 + x.size > 600 THEN list_append(a.starts, x.at) ELSE a.starts END, 'size': CASE WHEN a.size + 1 + x.size > 600 THEN x.size ELSE a.size + 1 + x.size END, 'at': x.at}}).starts AS st FROM l),
u AS (SELECT doc_id, ss, st, unnest(st) AS f, generate_subscripts(st, 1) - 1 AS ix FROM r)
SELECT doc_id, ix, array_to_string(ss[f : coalesce(st[ix + 2] - 1, len(ss))], ' ') AS text FROM u"""


def t24(spark, sf_dir):
    """Chunks put together again, every third one with a mark before it."""
    p = R.chunks(texts(spark, sf_dir), 600)
    return R.assembled(p, p.where("ix % 3 = 2").select("doc_id", "ix", F.concat(F.lit("* "), "text").alias("new"))).select("doc_id", F.md5("text").alias("digest"), "changed")


T24 = f"""SELECT doc_id, md5(string_agg(CASE WHEN ix % 3 = 2 THEN '* ' || text ELSE text END, ' ' ORDER BY ix)) AS digest, count(*) FILTER (ix % 3 = 2) AS changed FROM ({T07}) GROUP BY doc_id"""


def k16(spark, sf_dir):
    return R.corpus_windows(table(spark, sf_dir, "documents"))


K16 = r"""WITH n AS (SELECT source, doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w != '')) // 300 AS w FROM documents), b AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - w AS before FROM n WHERE w > 0)
SELECT source, doc_id, unnest(range(least(w, 150 - before)::BIGINT)) AS ix, 300 AS words FROM b WHERE before < 150"""


def k16_text(spark, sf_dir):
    d = _papers(spark, sf_dir)
    return d.select("doc_id", F.md5(R.untagged(F.coalesce("text", F.lit("")))).alias("digest"))


K16_TEXT = rf"""WITH {PAPERS_SQL}, a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(\S+)/[a-zA-Z$*+.,:()''`-]+(\s|$)', '\1\2', 'g'), '``\s*', '"', 'g') AS t FROM papers)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '\s*''''', '"', 'g'), '\s+([,.;:?!])', '\1', 'g'), '\s+', ' ', 'g'))) AS digest FROM a"""


def f21(spark, sf_dir):
    t = R.basic_tokens(F.coalesce("text", F.lit("")))
    return texts(spark, sf_dir).select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


F21 = rf"""WITH {TEXTS}, t AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(lower(coalesce(text, '')), '{T.MARKED}', '{T.BARE}'), '[̀-ͯ]', '', 'g'), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') AS ts FROM texts) SELECT doc_id, len(ts) AS tokens, md5(array_to_string(ts, ' ')) AS digest FROM t"""

QUERIES = {
    "p01_report": p01, "p10_cited_spans": p10, "p09_excerpts": p09, "p22_provider_warnings": p22, "u02_first_sources": u02, "p20_own_works": p20, "p17_upgraded_sources": p17, "g04_hidden_ranges": g04, "t11_front_matter": t11,
    "t17_prose": t17, "t07_chunks": t07, "t24_assembled": t24, "k16_windows": k16, "k16_untagged": k16_text, "f21_basic_tokens": f21,
}
ORACLES = {
    "p01_report": P01, "p10_cited_spans": f'{CITED} SELECT doc_id, "start", "end", source_id, citation FROM csp', "p09_excerpts": P09, "p22_provider_warnings": P22, "u02_first_sources": U02, "p20_own_works": P20, "p17_upgraded_sources": P17, "g04_hidden_ranges": G04,
    "t11_front_matter": T11, "t17_prose": T17, "t07_chunks": T07, "t24_assembled": T24, "k16_windows": K16, "k16_untagged": K16_TEXT, "f21_basic_tokens": F21,
}
