"""Queries on citations. Lists of references, works, names and the like are made of documents, pages and events, a row each, beside a few rows of our own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import authors as A_
from inkwell.operators import citations as C
from inkwell.operators import preparing as P
from inkwell.operators import reviewing as R
from inkwell.plans.common import FIXTURES, SENTENCES, STOP, TEXTS, TITLE, given, given_sql, quote, sql_name, sql_normal, sql_raw_words, texts, values
from inkwell.plans.texts_and_statistics import sql_count

LISTS = (
    (1, "[1] Smith, J. (2020). A study of inter-\nesting things. Journal of Things, 12(3), 45-67. doi:10.1000/XYZ123.\n[2] Lee, K., & Park, S. (2019b). Another study of many things. Science Letters, 4, 1-9. arXiv:1905.01234v2\n[3] World Things Association. Report on things. 2018. https://things.example.org/report."),
    (2, "1. Garcia M, Chen L. Deep models of weather. Nature Weather. 2017;5(2):101-9.\n2. Jones P. Old work (1899). Archive.\n3) Doe J. “The quoted title of a paper,” Proc. Conf., vol. 3, pp. 1-4, 2015."),
    (3, "Brown, A. (2001). First block entry.\nContinues here.\n\nGreen, B. (2002). Second block entry.\n\nWhite, C. (n.d.). Third."),
    (4, "Adams, D. (1979). One line entry. Pan.\nmore of it\nClarke, A. (1968). Another entry. Press."),
    (5, ""),
)
WORKS = (
    (1, "A study of interesting things", "Smith|John A", 2020, "Journal of Things", "12", "3", "45-67", "10.1000/xyz123", None, None, "journal-article", None, 120, "We study things that are interesting and report deep results.", None, "crossref"),
    (2, "Another study of many things.", "Lee|Kim;Park|Soo-Jin", 2019, "Science Letters", "4", None, "1 - 9", None, "https://sl.example.org/2", None, "journal-article", "1905.01234v2", 7, "Many things & models.", None, "arxiv"),
    (3, "Report on things", "World Things Association||o", 2018, None, None, None, None, None, "https://things.example.org/report", "Things Press", "book", None, None, None, None, "openalex"),
    (4, "Deep models of weather", "Garcia|Maria;Chen|Li;Diaz|P. Q.;Evans|E", 2017, "Nature Weather", "5", "2", "e101", "10.1000/w4", None, None, "journal-article", None, 999, "Deep neural models forecast weather patterns. Weather models improve.", "retracted", "crossref"),
    (5, "Deep models of weather", "Garcia|M.", 2017, None, None, None, None, None, None, None, "preprint", None, 1050, None, None, "arxiv"),
    (6, "Untitled?", "", None, "Annals", None, None, None, None, None, None, None, None, 0, None, None, "openalex"),
    (7, "Big team paper", "A|Ann;B|Bob;C|Cy;D|Di;E|Ed;F|Fay;G|Gus;H|Hal;I|Ida;J|Jo;K|Kim", 2021, "Proc. Teams", None, "7", "10–20", "10.1000/t7", None, "ACM", "proceedings-article", None, 3, None, None, "crossref"),
    (8, "Deep models of weather", "Garcia|Maria", 2017, "Nature Weather", None, None, None, "10.1000/w4", "https://w.example.org", None, None, None, 12, "Short.", None, "openalex"),
)
A, B, C_, D_ = (sql_name("doc_id", k) for k in "abcd")
#: A list of two or three entries for each document: its first line as a title, other parts from its id and checksum.
LISTS_FROM = f"""SELECT doc_id + 1000, '[1] ' || {A} || ', ' || upper(substr({B}, 1, 1)) || '. (' || CAST(1950 + doc_id % 77 AS STRING) || '). ' || {TITLE} || '. Journal of Things, ' || CAST(doc_id % 30 + 1 AS STRING) || '(' || CAST(doc_id % 6 + 1 AS STRING) || '), ' || CAST(doc_id % 90 + 1 AS STRING) || '-' || CAST(doc_id % 90 + 9 AS STRING) || '. doi:10.1000/' || substr(md5(coalesce(text, '')), 1, 10) || '.' || chr(10)
 || '[2] ' || {C_} || ', K., & ' || {D_} || ', S. (' || CAST(1960 + doc_id % 60 AS STRING) || 'b). On ' || lower({B}) || ' and ' || chr(10) || lower({C_}) || ' in the north. Science Letters, 4, 1-9. arXiv:1905.' || CAST(10000 + doc_id % 90000 AS STRING) || 'v2'
 || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '[3] ' || {D_} || ' Association. Report on ' || lower({A}) || '. 2018. https://' || lower({A}) || '.example.org/report.' ELSE '' END FROM {{documents}}"""
#: A work for each document; copies of a text have one DOI, so they merge.
WORKS_FROM = f"""SELECT doc_id + 1000, {TITLE}, {A} || '|' || {B} || CASE WHEN doc_id % 4 > 0 THEN ';' || {C_} || '|' || {D_} || '-' || {A} ELSE '' END || CASE WHEN doc_id % 4 > 1 THEN ';' || {D_} || ' Group||o' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(1950 + doc_id % 77 AS INT) END,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Journal of ' || coalesce(source, 'Things') END, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 30 + 1 AS STRING) END, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE CAST(doc_id % 6 + 1 AS STRING) END, CASE WHEN doc_id % 3 = 0 THEN 'e' || CAST(doc_id AS STRING) ELSE CAST(doc_id % 90 + 1 AS STRING) || ' - ' || CAST(doc_id % 90 + 9 AS STRING) END,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '10.1000/' || substr(md5(coalesce(text, '')), 1, 12) END, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'https://' || lower({A}) || '.example.org/' || CAST(doc_id AS STRING) END, CASE WHEN doc_id % 6 = 0 THEN {B} || ' Press' ELSE NULL END, CASE WHEN doc_id % 6 = 0 THEN 'book' WHEN doc_id % 6 = 1 THEN 'proceedings-article' WHEN doc_id % 6 = 2 THEN NULL ELSE 'journal-article' END,
 CASE WHEN doc_id % 9 = 0 THEN '1905.' || CAST(10000 + doc_id % 90000 AS STRING) || 'v2' ELSE NULL END, CAST(n_chars % 500 AS INT), CASE WHEN doc_id % 4 = 0 THEN NULL ELSE split_part(text, chr(10), 2) END, CASE WHEN doc_id % 50 = 7 THEN 'retracted' ELSE NULL END, CASE WHEN doc_id % 2 = 0 THEN 'crossref' ELSE 'openalex' END FROM {{documents}}"""
COLUMNS = ("work_id", "title", "authors", "year", "container", "volume", "issue", "pages", "doi", "url", "publisher", "type", "arxiv_id", "citations", "abstract", "retraction", "source")
KINDS = "work_id long, title string, authors string, year int, container string, volume string, issue string, pages string, doi string, url string, publisher string, type string, arxiv_id string, citations int, abstract string, retraction string, source string"


def works(spark, sf_dir) -> DataFrame:
    a = F.filter(F.split("authors", ";"), lambda x: x != "")
    one = lambda x: F.split(x, r"\|")
    named = F.transform(a, lambda x: F.struct(one(x)[0].alias("family"), F.when(one(x)[1] != "", one(x)[1]).alias("given"), F.coalesce(F.get(one(x), 2) == "o", F.lit(False)).alias("organization")))
    return given(spark, sf_dir, WORKS, KINDS, WORKS_FROM).withColumn("authors", named).withColumn("number", F.col("work_id"))


def _typed(rows) -> str:
    """The first row's columns as NULLs of the right type, so DuckDB infers text columns that begin with NULL."""
    return f"SELECT work_id, title, authors, year::INT AS year, container, volume, issue, pages, doi, url, publisher, type, arxiv_id, citations::INT AS citations, abstract, retraction, source FROM {given_sql(rows, WORKS_FROM, *COLUMNS)}"


WORKS_SQL = f"""w0 AS ({_typed(WORKS)}),
w AS (SELECT * REPLACE (list_transform(list_filter(string_split(authors, ';'), lambda x: x != ''), lambda a: {{'family': split_part(a, '|', 1), 'given': nullif(split_part(a, '|', 2), ''), 'organization': split_part(a, '|', 3) = 'o'}}) AS authors), work_id AS number FROM w0)"""


def lists(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, LISTS, "doc_id long, text string", LISTS_FROM)


def c01(spark, sf_dir):
    return C.split_references(lists(spark, sf_dir))


C01 = rf"""l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM {given_sql(LISTS, LISTS_FROM, 'doc_id', 'text')}), l1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ix FROM l0),
l2 AS (SELECT *, regexp_replace(line, '\s', '', 'g') != '' AS f FROM l1), l3 AS (SELECT *, count(*) FILTER (f) OVER d AS n, count(*) FILTER (regexp_matches(line, {quote(C.BRACKET)})) OVER d AS br, count(*) FILTER (regexp_matches(line, {quote(C.DOT)})) OVER d AS dt, f AND NOT coalesce(lag(f) OVER o, false) AS opens, count(*) FILTER (f) OVER o AS nf FROM l2 WINDOW d AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY ix)),
l4 AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id) AS blocks FROM l3), l5 AS (SELECT *, CASE WHEN br >= greatest(2, floor(n * 0.25)) THEN 'bracket' WHEN dt >= greatest(2, floor(n * 0.25)) THEN 'dot' WHEN blocks >= 2 THEN 'block' ELSE 'name' END AS kind FROM l4 WHERE f),
l6 AS (SELECT *, CASE kind WHEN 'bracket' THEN regexp_matches(line, {quote(C.BRACKET)}) WHEN 'dot' THEN regexp_matches(line, {quote(C.DOT)}) WHEN 'block' THEN opens ELSE regexp_matches(line, {quote(C.SURNAME)}) OR nf = 1 END AS s, CASE kind WHEN 'bracket' THEN regexp_replace(line, {quote(C.BRACKET)}, '') WHEN 'dot' THEN regexp_replace(line, {quote(C.DOT)}, '') ELSE line END AS b FROM l5),
l7 AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY ix)::INT AS entry FROM l6),
refs AS (SELECT doc_id, entry AS "index", trim(regexp_replace(regexp_replace(string_agg(b, chr(10) ORDER BY ix), '([^\s])-\n\s*([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS raw FROM l7 WHERE entry > 0 GROUP BY doc_id, entry)"""


def c02(spark, sf_dir):
    return C.identifiers(c01(spark, sf_dir)).drop("raw")


C02 = rf"""WITH {C01},
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '(?i)(?:doi:?\s*|https?://(?:dx\.)?doi\.org/)?(10\.[0-9]{{4,9}}/[^\s"<>]+)', ' ', 'g'), 'https?://[^\s"<>]+', ' ', 'g'), '(?i)arxiv:\s*\S+', ' ', 'g') AS body FROM refs),
y AS (SELECT *, list_filter(regexp_extract_all(body, '(?:^|[^0-9])\(\s*([0-9]{{4}}[a-z]?)\s*[,)]', 1), lambda y: left(y, 4)::INT BETWEEN 1500 AND 2027)[1] AS good, list_filter(regexp_extract_all(regexp_replace(body, '\s', '  ', 'g'), '(?:^|[^0-9–-])((?:18|19|20)[0-9]{{2}}[a-z]?)(?:$|[^0-9–)a-z-])', 1), lambda y: left(y, 4)::INT <= 2027)[-1] AS last FROM b),
z AS (SELECT *, coalesce(good, last) AS yy, regexp_extract(body, '\(\s*[0-9]{{4}}[a-z]?\s*[,)][^)]*?[\s.,:)]*(\S.*)$', 1) AS after, regexp_extract(body, '[“"]([^“”"]{{6,}}?)[.,]?[”"]', 1) AS quoted, regexp_replace(regexp_extract(raw, '(https?://[^\s"<>]+)', 1), '[.,;)]+$', '') AS u FROM y)
SELECT doc_id, "index", nullif(lower(regexp_replace(regexp_extract(raw, {quote(C.DOI)}, 1), '[.,;:)\]}}>]+$', '')), '') AS doi, nullif(regexp_extract(raw, {quote(C.ARXIV)}, 1), '') AS arxiv_id, CASE WHEN u != '' AND NOT regexp_matches(u, '(?i)doi\.org/') THEN u END AS url,
 left(yy, 4)::INT AS year, nullif(substr(yy, 5, 1), '') AS year_suffix, coalesce(CASE WHEN good IS NOT NULL THEN nullif(regexp_replace(regexp_extract(after, '^(.+?)(?:\.\s+[\p{{Lu}}*_“"(0-9]|\.?\s*$)', 1), '[*_]', '', 'g'), '') END, nullif(quoted, '')) AS title,
 CASE WHEN good IS NOT NULL THEN regexp_replace(regexp_extract(body, '^(.*?)\(\s*[0-9]{{4}}', 1), '[\s,;:.]+$', '') END AS lead FROM z"""


def lead_blocks(spark, sf_dir):
    """What stands before the year of each entry: its author block."""
    return c02(spark, sf_dir).where("lead is not null").select("doc_id", "index", "lead")


def c03(spark, sf_dir):
    """Authors of all entries; compared with plain scans in the tests."""
    p = A_.parsed(F.col("lead"))
    names = F.array_join(F.transform(F.col("p.authors"), lambda a: F.concat_ws("|", a["family"], a["given"])), "; ")
    return lead_blocks(spark, sf_dir).withColumn("p", p).select("doc_id", "index", names.alias("authors"), F.size("p.authors").alias("n"), F.col("p.truncated").alias("truncated"))


def c10(spark, sf_dir):
    return C.in_text(texts(spark, sf_dir)).withColumn("numbers", F.array_join(F.array_sort("numbers").cast("array<string>"), ","))


EXPAND = r"""list_distinct(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(spec, '[–—]', '-', 'g'), '[,;]'), lambda p: trim(p)), lambda p: regexp_full_match(p, '[0-9]+(\s*-\s*[0-9]+)?')),
 lambda p: CASE WHEN coalesce(nullif(regexp_extract(p, '-\s*([0-9]+)$', 1), '')::INT, regexp_extract(p, '^([0-9]+)', 1)::INT) - regexp_extract(p, '^([0-9]+)', 1)::INT BETWEEN 0 AND 60 THEN range(regexp_extract(p, '^([0-9]+)', 1)::INT, coalesce(nullif(regexp_extract(p, '-\s*([0-9]+)$', 1), '')::INT, regexp_extract(p, '^([0-9]+)', 1)::INT) + 1) ELSE [regexp_extract(p, '^([0-9]+)', 1)::BIGINT, regexp_extract(p, '-\s*([0-9]+)$', 1)::BIGINT] END)))"""
CITES = rf"""n0 AS (SELECT doc_id, regexp_extract_all(text, {quote(C.NUMERIC)}, 1) AS xs FROM texts), n1 AS (SELECT doc_id, unnest(xs) AS spec, generate_subscripts(xs, 1) - 1 AS ix FROM n0),
p0 AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(text, {quote(C.PARENTHESES)}, 1), lambda x: regexp_matches(x, '(?:19|20)[0-9]{{2}}')), lambda x: string_split(x, ';'))), lambda x: trim(x)), lambda x: regexp_matches(x, {quote(C.PART)})) AS xs FROM texts), p1 AS (SELECT doc_id, unnest(xs) AS raw, generate_subscripts(xs, 1) - 1 AS ix FROM p0),
a0 AS (SELECT doc_id, regexp_extract_all(text, {quote(C.NARRATIVE)}) AS xs FROM texts), a1 AS (SELECT doc_id, unnest(xs) AS raw, generate_subscripts(xs, 1) - 1 AS ix FROM a0),
cites AS (SELECT doc_id, 'numeric' AS kind, ix, '[' || spec || ']' AS raw, {EXPAND} AS ns, NULL AS surname, NULL::INT AS year, NULL AS year_suffix FROM n1
 UNION ALL SELECT doc_id, 'parenthetical', ix, raw, NULL, regexp_extract(raw, {quote(C.PART)}, 1), regexp_extract(raw, {quote(C.PART)}, 2)::INT, nullif(regexp_extract(raw, {quote(C.PART)}, 3), '') FROM p1
 UNION ALL SELECT doc_id, 'narrative', ix, raw, NULL, regexp_extract(raw, {quote(C.NARRATIVE)}, 1), regexp_extract(raw, {quote(C.NARRATIVE)}, 2)::INT, nullif(regexp_extract(raw, {quote(C.NARRATIVE)}, 3), '') FROM a1 WHERE NOT regexp_matches(regexp_extract(raw, {quote(C.NARRATIVE)}, 1), {quote(C.NO_NAME)}))"""

REFERENCES = tuple((d, i, f, o, y, s) for d in (-1, -3) for i, f, o, y, s in ((1, "Smith", False, 2020, None), (2, "Lee", False, 2019, None), (3, "Garcia", False, 2016, None), (4, "van Dyke", False, 2017, "b"), (5, "World Things", True, 2018, None)))
#: An entry of each document, which the text cites in the last sentence that `CITING` adds.
REFERENCES_FROM = f"SELECT doc_id, CAST(doc_id % 3 + 1 AS INT), {A}, doc_id % 10 = 0, CAST(1950 + doc_id % 70 + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS INT), CASE WHEN doc_id % 9 = 0 THEN 'a' ELSE NULL END FROM {{documents}}"
CITING = f"SELECT doc_id, coalesce(text, '') || ' It is known (' || {A} || ' et al., ' || CAST(1950 + doc_id % 70 AS STRING) || CASE WHEN doc_id % 6 = 0 THEN 'a' ELSE '' END || '; ' || {B} || ', 2001) and ' || CASE WHEN doc_id % 4 = 0 THEN 'shown [1, 3] and [2].' ELSE {A} || ' (1999) says so.' END FROM {{documents}}"
REF_COLS = ("doc_id", '"index"', "family", "organization", "year", "year_suffix")


def _check(spark, sf_dir):
    refs = given(spark, sf_dir, REFERENCES, "doc_id long, index int, family string, organization boolean, year int, year_suffix string", REFERENCES_FROM)
    return C.cross_check(C.in_text(given(spark, sf_dir, FIXTURES, "doc_id long, text string", CITING)), refs)


CHECK = f"""WITH texts AS (SELECT * FROM {given_sql(FIXTURES, CITING, 'doc_id', 'text')}), {CITES}, rf AS (SELECT * FROM {given_sql(REFERENCES, REFERENCES_FROM, *REF_COLS)}),
nn AS (SELECT doc_id, ix, raw, unnest(ns) AS n FROM cites WHERE kind = 'numeric'),
au AS (SELECT c.doc_id, c.kind, c.ix, c.raw, r."index", coalesce(lower(c.surname) = lower(r.family) OR ends_with(lower(r.family), ' ' || lower(c.surname)) OR ends_with(lower(c.surname), ' ' || lower(r.family)) OR (r.organization AND (starts_with(lower(r.family), lower(c.surname)) OR starts_with(lower(c.surname), lower(r.family)))), false) AS same, r.year = c.year AND (c.year_suffix IS NULL OR r.year_suffix IS NULL OR c.year_suffix = r.year_suffix) AS fits FROM cites c LEFT JOIN rf r USING (doc_id) WHERE kind != 'numeric'),
oc AS (SELECT doc_id, kind, ix, raw, bool_or(same AND coalesce(fits, false)) AS exact, bool_or(same) AS same FROM au GROUP BY ALL)"""


def _mask_names(spark, sf_dir, k):
    return _check(spark, sf_dir)[k]


def c20(spark, sf_dir):
    """Scores of entries against works on pairs of our own, from the parts."""
    return given(spark, sf_dir, PARTS, "id long, score double, title double, authors double, year double, container double", PARTS_FROM).select("id", C.status(*[F.col(c) for c in ("score", "title", "authors", "year", "container")]).alias("status"))


PARTS = ((1, 0.95, 0.99, 1.0, 1.0, 0.9), (2, 0.82, 0.75, None, None, None), (3, 0.7, 0.6, 0.5, 0.6, 0.2), (4, 0.9, 0.96, 0.0, 1.0, 0.4), (5, 0.9, 0.96, 0.0, 1.0, None), (6, 0.9, 0.9, 0.0, 1.0, 0.9), (7, 0.61, 0.9, 1.0, 0.0, 0.0), (8, 0.83, 0.54, 1.0, 1.0, 1.0))
PARTS_FROM = "SELECT doc_id + 100, doc_id * 37 % 101 / 100.0, doc_id * 53 % 97 / 96.0, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 / 2.0 END, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 2 * 1.0 END, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 10 / 10.0 END FROM {documents}"
C20 = f"""SELECT id, CASE WHEN coalesce(authors = 0, false) AND (title < 0.95 OR coalesce(year = 0, false) OR coalesce(container < 0.5, false)) THEN 'not_found' WHEN score >= 0.82 AND title >= 0.75 THEN 'verified' WHEN score >= 0.62 AND title >= 0.55 THEN 'likely' ELSE 'not_found' END AS status FROM {given_sql(PARTS, PARTS_FROM, 'id', 'score', 'title', 'authors', 'year', 'container')}"""
TITLES = ((1, "Deep Learning", "deep learning"), (2, "A Study of <i>Interesting</i> Things", "Study of interesting things: a review"), (3, "Rivers and tides", "Mountains and valleys of the north"), (4, "", "Nothing"), (5, "Effets du café sur l’été", "effets du cafe sur l'ete"), (6, "the cat the cat", "the cat sat"))
TITLES_FROM = f"SELECT doc_id + 100, {TITLE}, CASE doc_id % 4 WHEN 0 THEN upper(replace({TITLE}, 'ß', 'ss')) WHEN 1 THEN 'A review: ' || {TITLE} || ' <b>and more</b>' WHEN 2 THEN substr({TITLE}, 1, 30) ELSE {A} || ' ' || {TITLE} || ' ' || {B} END FROM {{documents}}"


def f04(spark, sf_dir):
    d = given(spark, sf_dir, TITLES, "id long, a string, b string", TITLES_FROM)
    a, b = F.col("a"), F.col("b")
    return d.select("id", T.normal_title(a).alias("normal"), F.round(T.dice(T.title_tokens(a), T.title_tokens(b)), 6).alias("dice"), F.round(T.title_similarity(a, b), 6).alias("similarity"), F.round(C.contained(a, b), 6).alias("contained"))


def sql_title(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(translate({x}, '{T.MARKED}', '{T.BARE}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g')), '<[^>]+>', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_title(x)}, ' '), lambda t: t != '')"


F04 = f"""WITH t AS (SELECT id, {sql_title('a')} AS normal, {sql_tokens('a')} AS ta, {sql_tokens('b')} AS tb FROM {given_sql(TITLES, TITLES_FROM, 'id', 'a', 'b')}),
d AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE 2 * list_sum(list_transform(list_distinct(ta), lambda t: least(len(list_filter(ta, lambda x: x = t)), len(list_filter(tb, lambda x: x = t))))) / (len(ta) + len(tb)) END AS dice, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS s, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS l FROM t)
SELECT id, normal, round(dice, 6) AS dice, round(CASE WHEN len(s) >= 4 AND len(list_filter(s, lambda t: list_contains(l, t))) / len(s) >= 0.95 THEN greatest(dice, 0.9) ELSE dice END, 6) AS similarity, round(CASE WHEN len(ta) = 0 THEN 0 ELSE len(list_filter(ta, lambda t: list_contains(tb, t))) / len(ta) END, 6) AS contained FROM d"""


def c24(spark, sf_dir):
    r = C.identifiers(c01(spark, sf_dir)).select("doc_id", F.col("index").alias("ref_id"), "doi", "title", "year", "raw")
    again = r.where("doc_id = 1 or doc_id % 5 = 0").withColumn("ref_id", F.col("ref_id") + 10)
    return C.duplicates(r.unionByName(again))


NOTICES = ((1, "RETRACTED: A paper", "", ""), (2, "A paper", "correction,Retraction", ""), (3, "A paper", "", "cites,is-retracted-by"), (4, "Withdrawn - a paper", "", ""), (5, "A paper on retracted work", "erratum", "has-review"), (6, "A paper", "expression_of_concern", ""))
NOTICES_FROM = f"SELECT doc_id + 100, CASE doc_id % 5 WHEN 0 THEN 'Retracted: ' WHEN 1 THEN 'WITHDRAWN - ' ELSE '' END || {TITLE}, CASE doc_id % 7 WHEN 0 THEN 'correction,Retraction' WHEN 1 THEN 'removal' WHEN 2 THEN 'expression_of_concern' ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN 'cites,is-retracted-by' ELSE 'has-review' END FROM {{documents}}"


def c25(spark, sf_dir):
    d = given(spark, sf_dir, NOTICES, "id long, title string, updates string, relations string", NOTICES_FROM)
    return d.select("id", C.retraction(F.col("title"), F.split("updates", ","), F.split("relations", ",")).alias("status"))


C25 = rf"""WITH n AS (SELECT *, list_filter(list_transform(string_split(updates, ','), lambda u: lower(u)), lambda u: u IN ('retraction', 'withdrawal', 'removal', 'expression_of_concern'))[1] AS u FROM {given_sql(NOTICES, NOTICES_FROM, 'id', 'title', 'updates', 'relations')})
SELECT id, CASE WHEN u = 'retraction' THEN 'retracted' WHEN u = 'withdrawal' THEN 'withdrawn' WHEN u = 'removal' THEN 'removed' WHEN u IS NOT NULL THEN u WHEN regexp_matches(relations, '(?i)retracted-by|has-retraction') THEN 'retracted' WHEN regexp_matches(title, '(?i)^\s*withdrawn\s*[:\-–]') THEN 'withdrawn' WHEN regexp_matches(title, '(?i)^\s*retracted\s*[:\-–]') THEN 'retracted' END AS status FROM n"""


def c26(spark, sf_dir):
    return C.claims(texts(spark, sf_dir)).select("doc_id", "ix", "score")


C26 = f"""WITH {SENTENCES}, s AS (SELECT doc_id, ix, {' + '.join(f"CASE WHEN regexp_matches(sentence, {quote(C.cue_pattern(p, c))}) THEN {w} ELSE 0 END" for p, w, c in C.CUES)} AS score FROM sen
 WHERE {sql_count('sentence', T.WORD)} >= 8 AND NOT regexp_matches(sentence, '\\?$') AND NOT regexp_matches(sentence, {quote(dict(P.PROTECTED)['cite'])})) SELECT * FROM s WHERE score >= 3"""


def _sentence_rows(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "text"))


def c27(spark, sf_dir):
    return C.keyphrases(_sentence_rows(spark, sf_dir)).withColumn("keyphrases", F.array_join("keyphrases", " "))


C27 = f"""WITH {SENTENCES}, r AS (SELECT doc_id, ix, {sql_raw_words('sentence')} AS raws FROM sen), t AS (SELECT doc_id, ix, unnest(raws) AS raw, generate_subscripts(raws, 1) - 1 AS pos FROM r), n AS (SELECT *, {sql_normal('raw')} AS word, regexp_full_match(raw, '[A-Z]{{2,6}}') AS acr FROM t),
k AS (SELECT *, length(word) + CASE WHEN acr THEN 4 ELSE 0 END + CASE WHEN pos > 0 AND regexp_matches(raw, '^[A-Z]') AND NOT acr THEN 3 ELSE 0 END + CASE WHEN contains(word, '-') THEN 2 ELSE 0 END AS v FROM n WHERE acr OR NOT (length(word) < 4 OR word IN {STOP} OR word IN ({', '.join(quote(g) for g in C.GENERIC)}) OR regexp_full_match(word, '[0-9]+'))),
g AS (SELECT doc_id, ix, word, min_by(v, pos) + count(*) - 1 AS score, min(pos) AS f FROM k GROUP BY ALL), top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, ix ORDER BY score DESC, f) <= 7)
SELECT doc_id, ix, string_agg(word, ' ' ORDER BY f) AS keyphrases FROM top GROUP BY doc_id, ix"""


def c28(spark, sf_dir):
    own = ((1, 0, "Deep neural weather models improve forecasts substantially."), (2, 0, "Interesting things deserve a careful study."))
    claims = given(spark, sf_dir, own, "doc_id long, ix int, text string", "SELECT item_id + 100, 0, text FROM {benchmark}")
    return C.rank_works(claims, works(spark, sf_dir))


def j14(spark, sf_dir):
    listed = given(spark, sf_dir, LISTS, "doc_id long, text string", LISTS_FROM.replace("{documents}", "(SELECT item_id AS doc_id, text FROM {benchmark})"))
    refs = C.identifiers(C.split_references(listed)).select((F.col("doc_id") * 100 + F.col("index")).alias("ref_id"), "raw", "title", "year", "doi", "lead")
    family = F.regexp_extract("lead", r"^([\p{L}'’\- ]+),", 1)
    named = F.when(F.coalesce(family, F.lit("")) != "", F.array(F.struct(family.alias("family"), F.lit(None).cast("string").alias("given"), F.lit(False).alias("organization")))).otherwise(F.array().cast("array<struct<family:string,given:string,organization:boolean>>"))
    refs = refs.withColumn("authors", named).drop("lead")
    for c in ("container", "volume", "pages"):
        refs = refs.withColumn(c, F.lit(None).cast("string"))
    return C.best_matches(refs, works(spark, sf_dir))


def a30(spark, sf_dir):
    return C.dedupe_works(works(spark, sf_dir).drop("authors", "number")).select("work_id", "title", "year", "doi", "url", "citations", "abstract", "retraction", "sources")


A30 = f"""WITH w AS (SELECT *, {sql_title('title')} || ':' || coalesce(year::VARCHAR, '') AS t FROM ({_typed(WORKS)})),
k0 AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || regexp_replace(arxiv_id, 'v[0-9]+$', '') ELSE 'title:' || t END AS k FROM w), k1 AS (SELECT *, CASE WHEN starts_with(k, 'title:') THEN coalesce(arg_min(CASE WHEN NOT starts_with(k, 'title:') THEN k END, CASE WHEN NOT starts_with(k, 'title:') THEN work_id END) OVER (PARTITION BY t), k) ELSE k END AS key FROM k0)
SELECT min(work_id) AS work_id, first(title ORDER BY length(title) DESC, work_id) AS title, first(year ORDER BY work_id) FILTER (year IS NOT NULL) AS year, first(doi ORDER BY work_id) FILTER (doi IS NOT NULL) AS doi, first(url ORDER BY work_id) FILTER (url IS NOT NULL) AS url, max(citations) AS citations, first(abstract ORDER BY length(coalesce(abstract, '')) DESC, work_id) AS abstract,
 first(retraction ORDER BY work_id) FILTER (retraction IS NOT NULL) AS retraction, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM k1 GROUP BY key"""

NAMES = ((1, "John Ronald Tolkien"), (2, "Ludwig van Beethoven"), (3, "Smith, Jane Q."), (4, "Plato"), (5, "Martin Luther King Jr."), (6, "Maria de la Cruz"), (7, "Doe,"))
NAMES_FROM = f"SELECT doc_id + 100, CASE doc_id % 6 WHEN 0 THEN {A} || ', ' || {B} || ' Q.' WHEN 1 THEN {A} || ' van der ' || {B} WHEN 2 THEN {A} WHEN 3 THEN {A} || '  ' || {B} || ' Jr.' WHEN 4 THEN {A} || ' ' || {B} || ' de la ' || {C_} ELSE {A} || ' ' || {B} || ' ' || {C_} || ' III' END FROM {{documents}}"


def f14(spark, sf_dir):
    return given(spark, sf_dir, NAMES, "id long, name string", NAMES_FROM).select("id", C.split_name(F.col("name")).alias("n")).select("id", "n.family", F.coalesce("n.given", F.lit("")).alias("given"))


PARTICLES = "van von de der den di da del della la le bin ibn al el ter ten du dos das".split()
F14 = f"""WITH RECURSIVE n AS (SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM {given_sql(NAMES, NAMES_FROM, 'id', 'name')}), p AS (SELECT id, n, list_filter(string_split(n, ' '), lambda x: lower(x) NOT IN ('jr', 'jr.', 'sr', 'sr.', 'ii', 'iii', 'iv', 'phd', 'md')) AS ps FROM n),
r(id, n, ps, s) AS (SELECT id, n, ps, len(ps) FROM p UNION ALL SELECT id, n, ps, s - 1 FROM r WHERE s > 2 AND lower(ps[s - 1]) IN ({', '.join(quote(x) for x in PARTICLES)})), m AS (SELECT id, n, ps, min(s) AS s FROM r GROUP BY ALL)
SELECT id, CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE array_to_string(ps[s : len(ps)], ' ') END AS family, CASE WHEN contains(n, ',') THEN trim(substr(n, instr(n, ',') + 1)) WHEN len(ps) <= 1 THEN '' ELSE array_to_string(ps[1 : s - 1], ' ') END AS given FROM m"""


def c29(spark, sf_dir):
    w = works(spark, sf_dir)
    return reduce(DataFrame.unionByName, [C.formatted(w, s).withColumn("style", F.lit(s)) for s in C.STYLES])


def _author(form: str) -> str:
    return f"list_transform(authors, lambda a: CASE WHEN a.organization OR a.given IS NULL THEN a.family ELSE {form} END)"


def _initials(dot: str, apart: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(replace(a.given, '.', ' '), '\\s+'), lambda p: p != ''), lambda p: array_to_string(list_transform(list_filter(string_split(p, '-'), lambda x: x != ''), lambda x: upper(left(x, 1)) || '{dot}'), '-')), '{apart}')"


def _and(xs: str, word: str, oxford: bool) -> str:
    return f"CASE WHEN n <= 1 THEN array_to_string({xs}, '') WHEN n = 2 THEN {xs}[1] || ' {word} ' || {xs}[2] ELSE array_to_string({xs}[1 : n - 1], ', ') || '{',' if oxford else ''} {word} ' || {xs}[n] END"


def _dot(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[.?!]$') THEN {x} ELSE {x} || '.' END"


def _g(before: str, x: str, after: str = "") -> str:
    return f"coalesce('{before}' || {x} || '{after}', '')"


PUB = f"coalesce({_dot('publisher')} || ' ', '')"
STYLE_SQL = {
    "apa": f"CASE WHEN n > 0 THEN {_dot('apa_who')} || ' ' ELSE '' END || CASE WHEN year IS NULL THEN '(n.d.). ' ELSE '(' || year || '). ' END || CASE WHEN book THEN t || '. ' || {PUB} ELSE t || '. ' || CASE WHEN container IS NULL THEN '' ELSE container || {_g(', ', 'volume')} || {_g('(', 'issue', ')')} || {_g(', ', 'pp')} || '. ' END END || coalesce(link, '')",
    "mla": f"CASE WHEN n > 0 THEN {_dot('mla_who')} || ' ' ELSE '' END || CASE WHEN book THEN t || '. ' || {_g('', 'publisher', ', ')} || {_g('', 'year', '.')} ELSE '“' || t || '.” ' || CASE WHEN container IS NULL THEN {_g('', 'year', '. ')} ELSE container || CASE WHEN len(bits) > 0 THEN ', ' || array_to_string(bits, ', ') ELSE '' END || '. ' END END || {_g('', 'link', '.')}",
    "ieee": f"'[' || number || '] ' || CASE WHEN n > 0 THEN CASE WHEN n > 6 THEN ini[1] || ' et al.' ELSE {_and('ini', 'and', True)} END || ', ' ELSE '' END || CASE WHEN book THEN t || '. ' || {_g('', 'publisher', ', ')} || {_g('', 'year', '.')} ELSE '“' || t || ',” ' || CASE WHEN container IS NULL THEN {_g('', 'year')} ELSE container || {_g(', vol. ', 'volume')} || {_g(', no. ', 'issue')} || coalesce(', ' || CASE WHEN regexp_matches(pages, '[-–—]') THEN 'pp.' ELSE 'Art.' END || ' ' || pp, '') || {_g(', ', 'year')} END || coalesce(', doi: ' || doi || '.', '.') END",
    "chicago": f"CASE WHEN n > 0 THEN {_dot('chi_who')} || ' ' ELSE '' END || coalesce(year || '. ', 'n.d. ') || CASE WHEN book THEN t || '. ' || {PUB} ELSE '“' || t || '.” ' || CASE WHEN container IS NULL THEN '' ELSE container || {_g(' ', 'volume')} || {_g(' (', 'issue', ')')} || {_g(': ', 'pp')} || '. ' END END || {_g('', 'link', '.')}",
    "harvard": f"CASE WHEN n > 0 THEN CASE WHEN n > 3 THEN fc[1] || ' et al.' ELSE {_and('fc', 'and', False)} END || ' ' ELSE '' END || coalesce('(' || year || ') ', '(no date) ') || CASE WHEN book THEN t || '. ' || {PUB} ELSE '‘' || t || '’' || CASE WHEN container IS NULL THEN '' ELSE ', ' || container || {_g(', ', 'volume')} || {_g('(', 'issue', ')')} || {_g(', pp. ', 'pp')} END || '. ' END || coalesce('doi: ' || doi || '.', 'Available at: ' || url || '.', '')",
    "vancouver": f"number || '. ' || CASE WHEN n > 0 THEN CASE WHEN n > 6 THEN array_to_string(va[1:6], ', ') || ', et al' ELSE array_to_string(va, ', ') END || '. ' ELSE '' END || {_dot('title')} || ' ' || CASE WHEN book THEN {_g('', 'publisher', '; ')} || {_g('', 'year', '.')} ELSE {_g('', 'container', '. ')} || CASE WHEN tail != '' THEN tail || '.' ELSE '' END END || {_g(' doi:', 'doi')}",
}
C29 = f"""WITH {WORKS_SQL},
a AS (SELECT *, len(authors) AS n, {_author("a.family || ', ' || " + _initials('.', ' '))} AS fi, {_author("a.family || ', ' || " + _initials('.', ''))} AS fc, {_author("a.given || ' ' || a.family")} AS gf, {_author(_initials('.', ' ') + " || ' ' || a.family")} AS ini, {_author("a.family || ', ' || a.given")} AS fg,
 {_author("a.family || ' ' || replace(" + _initials('', '') + ", '-', '')")} AS va, regexp_replace(title, '\\.+$', '') AS t, regexp_replace(pages, '\\s*[-–—]\\s*', '–', 'g') AS pp, coalesce('https://doi.org/' || doi, url) AS link, coalesce(type, '') = 'book' OR (container IS NULL AND publisher IS NOT NULL AND coalesce(type, '') != 'journal-article') AS book FROM w),
b AS (SELECT *, CASE WHEN n = 1 THEN fi[1] WHEN n <= 20 THEN array_to_string(fi[1 : n - 1], ', ') || ', & ' || fi[n] ELSE array_to_string(fi[1:19], ', ') || ', . . . ' || fi[n] END AS apa_who, CASE WHEN n = 1 THEN fg[1] WHEN n = 2 THEN fg[1] || ', and ' || gf[2] ELSE fg[1] || ', et al' END AS mla_who, list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN fg[1] ELSE gf[i] END) AS mx,
 list_filter([ 'vol. ' || volume, 'no. ' || issue, year::VARCHAR, 'pp. ' || pp ], lambda x: x IS NOT NULL) AS bits, {_g('', 'year')} || {_g(';', 'volume')} || {_g('(', 'issue', ')')} || {_g(':', "replace(pp, '–', '-')")} AS tail FROM a),
c AS (SELECT *, CASE WHEN n > 10 THEN array_to_string(list_append(mx[1:7], 'et al.'), ', ') WHEN n = 2 THEN fg[1] || ', and ' || gf[2] ELSE {_and('mx', 'and', True)} END AS chi_who FROM b)
{' UNION ALL '.join(f"SELECT work_id, '{s}' AS style, rtrim({x}) AS text FROM c" for s, x in STYLE_SQL.items())}"""


def c29_in_text(spark, sf_dir):
    w = works(spark, sf_dir)
    return reduce(DataFrame.unionByName, [C.formatted_in_text(w, s).withColumn("style", F.lit(s)) for s in C.STYLES])


_F = ["authors[1].family", "authors[2].family", "authors[3].family"]
C29T = f"""WITH {WORKS_SQL}, a AS (SELECT *, len(authors) AS n, coalesce(year::VARCHAR, 'n.d.') AS y, {_F[0]} AS a, {_F[1]} AS b, {_F[2]} AS c FROM w)
SELECT work_id, 'ieee' AS style, '[' || number || ']' AS text FROM a UNION ALL SELECT work_id, 'vancouver', '(' || number || ')' FROM a
UNION ALL SELECT work_id, 'mla', CASE n WHEN 0 THEN '("' || left(title, 30) || '")' WHEN 1 THEN '(' || a || ')' WHEN 2 THEN '(' || a || ' and ' || b || ')' ELSE '(' || a || ' et al.)' END FROM a
UNION ALL SELECT work_id, 'chicago', CASE n WHEN 0 THEN '(' || y || ')' WHEN 1 THEN '(' || a || ' ' || y || ')' WHEN 2 THEN '(' || a || ' and ' || b || ' ' || y || ')' WHEN 3 THEN '(' || a || ', ' || b || ', and ' || c || ' ' || y || ')' ELSE '(' || a || ' et al. ' || y || ')' END FROM a
UNION ALL SELECT work_id, 'harvard', CASE n WHEN 0 THEN '(' || y || ')' WHEN 1 THEN '(' || a || ', ' || y || ')' WHEN 2 THEN '(' || a || ' and ' || b || ', ' || y || ')' WHEN 3 THEN '(' || a || ', ' || b || ' and ' || c || ', ' || y || ')' ELSE '(' || a || ' et al., ' || y || ')' END FROM a
UNION ALL SELECT work_id, 'apa', CASE n WHEN 0 THEN '(' || array_to_string(string_split(title, ' ')[1:3], ' ') || ', ' || y || ')' WHEN 1 THEN '(' || a || ', ' || y || ')' WHEN 2 THEN '(' || a || ' & ' || b || ', ' || y || ')' ELSE '(' || a || ' et al., ' || y || ')' END FROM a"""


def c30(spark, sf_dir):
    return C.bibtex(works(spark, sf_dir))


def _safe(x: str) -> str:
    return f"regexp_replace({x}, '([&%$#_])', '\\\\\\1', 'g')"


def _ascii(x: str) -> str:
    return f"regexp_replace(translate({x}, '{T.MARKED}', '{T.BARE}'), '[^A-Za-z0-9]', '', 'g')"


def _field(name: str, x: str) -> str:
    return f"'  {name} = {{' || {x} || '}}'"


C30 = f"""WITH {WORKS_SQL}, k AS (SELECT *, CASE WHEN type = 'book' THEN 'book' WHEN type = 'proceedings-article' THEN 'inproceedings' WHEN container IS NOT NULL THEN 'article' ELSE 'misc' END AS kind, array_to_string(list_transform(authors, lambda a: CASE WHEN a.organization OR a.given IS NULL THEN '{{' || a.family || '}}' ELSE a.family || ', ' || a.given END), ' and ') AS who,
 coalesce(nullif(lower({_ascii("coalesce(authors[1].family, 'anon')")}), ''), 'anon') || coalesce(year::VARCHAR, '') || coalesce(list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda w: lower({_ascii('w')})), lambda w: length(w) > 3 AND w NOT IN ('with', 'from', 'that', 'this', 'using', 'their', 'which', 'toward', 'towards'))[1], '') AS key FROM w)
SELECT work_id, '@' || kind || '{{' || key || ',' || chr(10) || array_to_string(list_filter([CASE WHEN who != '' THEN {_field('author', _safe('who'))} END, {_field('title', "'{' || " + _safe('title') + " || '}'")}, CASE WHEN kind = 'inproceedings' THEN {_field('booktitle', _safe('container'))} ELSE {_field('journal', _safe('container'))} END, {_field('year', 'year')}, {_field('volume', _safe('volume'))}, {_field('number', _safe('issue'))},
 {_field('pages', "regexp_replace(pages, '\\s*[-–—]\\s*', '--', 'g')")}, {_field('publisher', _safe('publisher'))}, {_field('doi', _safe('doi'))}, CASE WHEN doi IS NULL THEN {_field('url', _safe('url'))} END, {_field('eprint', _safe('arxiv_id'))}, CASE WHEN arxiv_id IS NOT NULL THEN '  archivePrefix = {{arXiv}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS text FROM k"""


def c31(spark, sf_dir):
    return C.ris(works(spark, sf_dir))


C31 = f"""WITH {WORKS_SQL}, k AS (SELECT *, CASE WHEN type = 'book' THEN 'BOOK' WHEN type = 'proceedings-article' THEN 'CONF' WHEN container IS NOT NULL THEN 'JOUR' ELSE 'GEN' END AS kind, regexp_split_to_array(pages, '\\s*[-–—]\\s*') AS cut FROM w)
SELECT work_id, array_to_string(list_filter(['TY  - ' || kind] || list_transform(authors, lambda a: 'AU  - ' || CASE WHEN a.organization OR a.given IS NULL THEN a.family ELSE a.family || ', ' || a.given END) || ['TI  - ' || title, CASE WHEN kind = 'CONF' THEN 'T2' ELSE 'JO' END || '  - ' || container, 'PY  - ' || year, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || cut[1], 'EP  - ' || cut[2], 'PB  - ' || publisher, 'DO  - ' || doi, 'UR  - ' || url, 'ER  - '], lambda x: x IS NOT NULL), chr(10)) AS text FROM k"""


def x01(spark, sf_dir):
    return C.to_sources(works(spark, sf_dir))


X01 = f"""WITH {WORKS_SQL} SELECT coalesce('doi:' || doi, url, 'title:' || lower(title)) AS source_id, title, concat_ws('. ', title, abstract) AS text, nullif(array_to_string(list_transform(authors[1:3], lambda a: a.family), ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END, '') AS authors, year, coalesce('https://doi.org/' || doi, url) AS url FROM w"""

SPECS = ((1, "1-4, 7"), (2, "3"), (3, "5–2"), (4, "1-100"), (5, "2,2;3 - 4"), (6, "x, 9"))
SPECS_FROM = "SELECT doc_id + 100, CAST(doc_id % 9 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '–' ELSE ' - ' END || CAST(doc_id % 9 + doc_id % 70 AS STRING) || ', ' || CAST(n_chars % 100 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN ';x' ELSE ';' || CAST(doc_id % 4 AS STRING) END FROM {documents}"


def f12(spark, sf_dir):
    return given(spark, sf_dir, SPECS, "id long, spec string", SPECS_FROM).select("id", F.array_join(F.array_sort(T.expand_numbers(F.col("spec"))).cast("array<string>"), ",").alias("numbers"))


CHECKS_FROM = """SELECT CAST(floor(doc_id / 10) AS BIGINT) + 100, CAST(doc_id % 10 AS INT), 'Raw entry ' || CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'likely' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'unchecked' ELSE 'verified' END, doc_id - doc_id % 3 + 1000, CASE doc_id % 4 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'retracted,duplicate' ELSE '' END FROM {documents}"""
CHECKS = ((1, 1, "Lost entry", "verified", -5, ""), (1, 2, "Known entry", "verified", 1, "incomplete_reference"), (1, 3, "Open entry", "not_found", 2, "missing"))
CHECK_COLS = ("doc_id", '"index"', "raw", "status", "work_id", "flags")


def _checks(spark, sf_dir):
    """Entries of ten documents each as checked lists; their works are those made of documents."""
    c = given(spark, sf_dir, CHECKS, "doc_id long, index int, raw string, status string, work_id long, flags string", CHECKS_FROM)
    return c.withColumn("flags", F.filter(F.split("flags", ","), lambda f: f != ""))


def a20(spark, sf_dir):
    return C.verification_counts(_checks(spark, sf_dir))


def c32(spark, sf_dir):
    return C.corrected_list(_checks(spark, sf_dir), works(spark, sf_dir), "apa")


def c32_bibtex(spark, sf_dir):
    return C.corrected_bibtex(_checks(spark, sf_dir), works(spark, sf_dir))


CHECKS_SQL = f"ck AS (SELECT * FROM {given_sql(CHECKS, CHECKS_FROM, *CHECK_COLS)})"
COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in C.STATUSES)
A20 = f"WITH {CHECKS_SQL} SELECT doc_id, {COUNTS}, count(*) FILTER (len(list_filter(string_split(flags, ','), lambda f: f NOT IN ('', 'incomplete_reference', 'duplicate'))) > 0) AS flagged FROM ck GROUP BY doc_id"
C32 = f"""WITH {CHECKS_SQL}, fm AS ({C29}) SELECT doc_id, string_agg(CASE WHEN status IN ('verified', 'likely', 'mismatch') AND fm.text IS NOT NULL THEN fm.text ELSE raw END, chr(10) ORDER BY "index") AS text FROM ck LEFT JOIN fm ON fm.work_id = ck.work_id AND style = 'apa' GROUP BY doc_id"""
C32_BIBTEX = f"""WITH {CHECKS_SQL}, bt AS ({C30}), f AS (SELECT doc_id, work_id, min("index") AS i FROM ck WHERE status IN ('verified', 'likely', 'mismatch') GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM f JOIN bt USING (work_id) GROUP BY doc_id"""

def io39(spark, sf_dir):
    """The latest works of the first author of each tenth work (at most three each)."""
    w = works(spark, sf_dir)
    people = w.where("work_id % 10 = 0 and size(authors) > 0").select(F.col("work_id").alias("who"), F.col("authors")[0]["family"].alias("family"), F.concat(F.left(F.col("authors")[0]["given"], F.lit(1)), F.lit(".")).alias("given"))
    return R.own_documents(w, people, 3).select("who", "source_id", "title", F.md5("text").alias("md5"), "year")


IO39 = f"""WITH {WORKS_SQL}, a AS (SELECT work_id, title, abstract, year, doi, unnest(authors) AS a FROM w), p AS (SELECT work_id AS who, lower(authors[1].family) AS f, lower(left(authors[1].given, 1)) AS g FROM w WHERE work_id % 10 = 0 AND len(authors) > 0 AND authors[1].given IS NOT NULL),
j AS (SELECT DISTINCT who, work_id, title, abstract, year, doi FROM a JOIN p ON lower(a.family) = f AND starts_with(lower(coalesce(a.given, '')), g) WHERE NOT a.organization), t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY who ORDER BY year DESC NULLS LAST, work_id) <= 3)
SELECT who, coalesce('own:doi:' || lower(doi), 'own:' || work_id) AS source_id, title, md5(concat_ws('. ', title, nullif(abstract, ''))) AS md5, year FROM t WHERE length(concat_ws('. ', title, nullif(abstract, ''))) > 40"""

QUERIES = {
    "io39_own_works": io39, "a20_verification_counts": a20, "c32_corrected_list": c32, "c32_corrected_bibtex": c32_bibtex, "c01_reference_entries": c01, "c02_identifiers": c02, "c03_authors": c03, "c10_in_text_citations": c10, "c11_missing": lambda s, d: _mask_names(s, d, 0), "c11_uncited": lambda s, d: _mask_names(s, d, 1), "c11_style": lambda s, d: _mask_names(s, d, 2), "c22_status": c20, "f04_title_similarity": f04, "c24_duplicates": c24, "c25_retraction": c25,
    "c26_claims": c26, "c27_keyphrases": c27, "c28_ranked_works": c28, "j14_best_matches": j14, "a30_merged_works": a30, "f14_names": f14, "c29_formatted": c29, "c29_in_text": c29_in_text, "c30_bibtex": c30, "c31_ris": c31, "x01_sources": x01, "f12_expand_numbers": f12,
}
ORACLES = {
    "io39_own_works": IO39, "a20_verification_counts": A20, "c32_corrected_list": C32, "c32_corrected_bibtex": C32_BIBTEX, "c01_reference_entries": f"WITH {C01} SELECT * FROM refs", "c02_identifiers": C02, "c10_in_text_citations": f"WITH {TEXTS}, {CITES} SELECT * EXCLUDE (ns), array_to_string(list_sort(ns), ',') AS numbers FROM cites",
    "c11_missing": f"""{CHECK} SELECT doc_id, raw, 'no reference ' || n AS reason FROM nn WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.doc_id = nn.doc_id AND rf."index" = nn.n) UNION ALL SELECT doc_id, raw, CASE WHEN same THEN 'other year' ELSE 'no such author' END FROM oc WHERE NOT exact""",
    "c11_uncited": f"""{CHECK} SELECT doc_id, "index" FROM rf WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.doc_id = rf.doc_id AND n = rf."index") AND NOT EXISTS (SELECT 1 FROM au WHERE au.doc_id = rf.doc_id AND au."index" = rf."index" AND same AND fits)""",
    "c11_style": f"""{CHECK}, f AS (SELECT doc_id, n, min(ix) AS ix FROM nn GROUP BY ALL), o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY ix, n) AS i FROM f), q AS (SELECT doc_id, count(*) > 2 AND bool_or(i != n) AS odd FROM o GROUP BY doc_id), s AS (SELECT doc_id, count(*) FILTER (kind = 'numeric') AS n, count(*) FILTER (kind != 'numeric') AS a FROM cites GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 AND a > 0 THEN 'mixed' WHEN n > 0 THEN 'numeric' ELSE 'author-year' END AS style, n >= 5 AND coalesce(odd, false) AS out_of_order FROM s LEFT JOIN q USING (doc_id)""",
    "c22_status": C20, "f04_title_similarity": F04, "c25_retraction": C25, "c26_claims": C26, "c27_keyphrases": C27, "a30_merged_works": A30, "f14_names": F14, "c29_formatted": C29, "c29_in_text": C29T, "c30_bibtex": C30, "c31_ris": C31, "x01_sources": X01,
    "f12_expand_numbers": f"SELECT id, array_to_string(list_sort({EXPAND}), ',') AS numbers FROM {given_sql(SPECS, SPECS_FROM, 'id', 'spec')}",
}
