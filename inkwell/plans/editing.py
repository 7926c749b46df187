"""Queries on rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import preparing as P
from inkwell.operators import rewriting as R
from inkwell.plans.common import TEXTS, given, given_sql, quote, sql_simple_sentences, texts, values
from inkwell.plans.texts_and_statistics import sql_count, sql_matches, sql_syllables

PAIRS = (
    (1, "The {{P1}} study of 12 sites in 3 countries found that, in order to learn, people must sleep for 8 hours.", "The {{P1}} study of 12 sites in 3 countries found that people must sleep for 8 hours to learn well."),
    (2, "The {{P1}} study of 12 sites in 3 countries found that people must sleep {{P2}} for 8 hours every day.", "Moreover, we delve into sleep {{P1}} {{P1}} {{P9}} — not only for 9 hours, but also **more**."),
    (3, "Short text.", ""),
    (4, "One two three. Four five six. Seven eight nine. Ten eleven twelve.", "# Title\nOne two three. Four five six. Seven eight nine. Ten eleven twelve."),
    (5, "same words here", "same words here"),
)
REPLIES = ((1, "```text\nHello there.\n```"), (2, "Sure, here is the rewritten passage:\nThe cat sat."), (3, "“Quoted whole.”"), (4, "Revised version: plain"), (5, '"A" and "B"'), (6, "  spaced  "))
REPLIES_FROM = """SELECT conv_id * 1000 + turn, CASE turn % 6 WHEN 0 THEN '```text' || chr(10) || text || chr(10) || '```' WHEN 1 THEN 'Sure, here is the revised text:' || chr(10) || text WHEN 2 THEN '“' || text || '”' WHEN 3 THEN 'Rewritten passage: ' || text WHEN 4 THEN ' ' || text || chr(10) ELSE text END FROM {conversations} WHERE text IS NOT NULL"""


#: Each turn of a conversation and a changed form of it.
PAIRS_FROM = """SELECT conv_id * 1000 + turn, text, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'Moreover, we delve into ' || CAST(turn AS STRING) || ' things. ' || replace(text, ' the ', ' a ') WHEN 2 THEN replace(text, ', ', ' — ') WHEN 3 THEN upper(substr(text, 1, 20)) || ' not only this, but also **that** ' || CAST(conv_id AS STRING) ELSE '' END FROM {conversations} WHERE text IS NOT NULL"""


def _pairs(spark, sf_dir):
    return given(spark, sf_dir, PAIRS, "id long, before string, after string", PAIRS_FROM)


def sql_hits(text: str, patterns) -> str:
    p = f"(?i){R.EDGE}(?:" + "|".join(x.replace(" ", "  ") for x in patterns) + f"){R.EDGE}"
    doubled = f"' ' || regexp_replace({text}, {quote(f'({R.EDGE})')}, '\\1\\1', 'g') || ' '"
    return f"len(regexp_extract_all({doubled}, {quote(p)}))"


def w21(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(R.problems(F.col("before"), F.col("after"), "balanced"), "; ").alias("problems"))


def _bag(x: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace({x}, '{P.PLACEHOLDER}', ' ', 'g'), {quote(P.NUMBER)}, 1), lambda n: replace(n, '−', '-'))"


def _more(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x)))) > 0"


W21 = rf"""WITH p AS (SELECT id, before, "after", regexp_extract_all(before, '{P.PLACEHOLDER}', 1) AS want, regexp_extract_all("after", '{P.PLACEHOLDER}', 1) AS got, {_bag('before')} AS nb, {_bag('"after"')} AS na, {sql_count('before', T.WORD)} AS n, {sql_count('"after"', T.WORD)} AS m FROM {given_sql(PAIRS, PAIRS_FROM, 'id', 'before', '"after"')})
SELECT id, array_to_string(list_filter([CASE WHEN len(list_filter(want, lambda x: NOT list_contains(got, x))) > 0 THEN 'placeholders missing' END, CASE WHEN len(list_filter(got, lambda x: NOT list_contains(want, x))) > 0 OR len(got) > len(list_distinct(got)) THEN 'placeholders invented or repeated' END,
 CASE WHEN {_more('nb', 'na')} THEN 'numbers dropped' END, CASE WHEN {_more('na', 'nb')} THEN 'numbers added' END, CASE WHEN n >= 12 AND (m / n < 0.65 OR m / n > 1.35) THEN 'length' END, CASE WHEN regexp_matches("after", '(?m)\*\*|__|^#+\s') THEN 'markdown' END, CASE WHEN trim("after") = '' THEN 'empty' END], lambda x: x IS NOT NULL), '; ') AS problems FROM p"""


def w23(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.array_join(R.style_issues(F.col("before"), F.col("after")), "; ").alias("issues"))


def _parts(x: str) -> str:
    return f"list_filter({sql_simple_sentences(x)}, lambda s: {sql_count('s', T.WORD)} >= 3)"


W23 = rf"""WITH p AS (SELECT id, before, "after", {_parts('before')} AS a, {_parts('"after"')} AS b FROM {given_sql(PAIRS, PAIRS_FROM, 'id', 'before', '"after"')}), q AS (SELECT *, len(list_filter(a, lambda s: regexp_matches(s, {quote(R.REWRITE_OPENERS)}))) AS oa, len(list_filter(b, lambda s: regexp_matches(s, {quote(R.REWRITE_OPENERS)}))) AS ob, list_transform(b, lambda s: {sql_count('s', T.WORD)}) AS l FROM p)
SELECT id, array_to_string(list_filter([CASE WHEN {sql_hits('"after"', R.INFLATED)} > 0 THEN 'inflated words' END, CASE WHEN ob > 0 AND ob >= oa THEN 'stock openers' END, CASE WHEN len(l) >= 4 AND list_stddev_pop(l) < 0.22 * list_avg(l) THEN 'flat rhythm' END,
 CASE WHEN {sql_count('"after"', '—|[ ]–[ ]')} > {sql_count('before', '—|[ ]–[ ]')} THEN 'dashes' END, CASE WHEN regexp_matches("after", '(?i)not only[^.]*but also') AND NOT regexp_matches(before, '(?i)not only') THEN 'not only' END], lambda x: x IS NOT NULL), '; ') AS issues FROM q"""


def w24(spark, sf_dir):
    return R.writing_quality(texts(spark, sf_dir))


PASSIVE = f"(?i){R.EDGE}{R.PASSIVE[4:]}{R.EDGE}"


def _clamp(x: str) -> str:
    return f"floor(round(least(100, greatest(0, {x})), 9) + 0.5)::INT"


W24 = rf"""WITH {TEXTS}, a AS (SELECT doc_id, text AS t, {sql_simple_sentences('text')} AS s, list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda w: {sql_syllables('w')}) AS syl, {sql_count('text', T.WORD)} AS words FROM texts),
b AS (SELECT *, list_filter(list_transform(s, lambda x: {sql_count('x', T.WORD)}), lambda n: n >= 3) AS l, greatest(words, 1) AS w FROM a), c AS (SELECT *, greatest(len(l), 1) AS n, coalesce(list_avg(l), 0) AS m FROM b),
d AS (SELECT *, {sql_hits('t', R.INFLATED)} + {sql_hits('t', [p for p, _ in R.PLAIN])} + {sql_hits('t', R.STOCK)} + len(list_filter(s, lambda x: regexp_matches(x, {quote(R.OPENERS)}))) AS pad, CASE WHEN m > 0 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / len(l)) / m ELSE 0 END AS cv,
 len(list_filter(l, lambda x: x > 35)) / n AS lo, len(list_filter(syl, lambda x: x >= 4)) / w AS lw, coalesce(list_sum(syl), 0) / w AS sy, len({sql_matches("' ' || t || ' '", PASSIVE)}) / n AS pa, CASE WHEN words > 0 THEN {sql_count('t', R.SPECIFIC)} / words * 100 ELSE 0 END AS sp FROM c),
e AS (SELECT doc_id, {_clamp('100 - pad / w * 100 * 28')} AS "plain", {_clamp('100 - greatest(0, m - 22) * 4 - lo * 120 - greatest(0, lw - 0.12::DOUBLE) * 300 - greatest(0, sy - 1.75::DOUBLE) * 80')} AS easy, CASE WHEN len(l) < 3 THEN 100 ELSE {_clamp('cv / 0.45::DOUBLE * 100')} END AS variety, {_clamp('100 - greatest(0, pa - 0.25::DOUBLE) * 140')} AS active, {_clamp('sp / 4 * 100')} AS specific FROM d)
SELECT *, {_clamp('"plain" * 0.3::DOUBLE + easy * 0.2::DOUBLE + variety * 0.15::DOUBLE + active * 0.15::DOUBLE + specific * 0.2::DOUBLE')} AS score FROM e"""


def a19(spark, sf_dir):
    """The most generic texts of 40 words or more (a report of 50)."""
    d = texts(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"), F.round(R.specificity(F.col("text")), 6).alias("specificity"))
    return d.where("words >= 40 and specificity < 2").orderBy("specificity", F.desc("words"), "doc_id").limit(50)


A19 = f"""WITH {TEXTS}, d AS (SELECT doc_id, {sql_count('text', T.WORD)} AS words, {sql_count('text', R.SPECIFIC)} AS k FROM texts), s AS (SELECT doc_id, words, round(k / words * 100, 6) AS specificity FROM d WHERE words >= 40) SELECT * FROM s WHERE specificity < 2 ORDER BY specificity, words DESC, doc_id LIMIT 50"""


def f19(spark, sf_dir):
    """A changed text is an array's only item: a filter on it would go below the projection and change every text again."""
    t = F.coalesce("text", F.lit(""))
    changed = F.filter(F.array(F.struct(t.alias("t"), R.plain_wording(t).alias("p"))), lambda x: x["t"] != x["p"])
    return texts(spark, sf_dir).select("doc_id", F.inline(changed)).select("doc_id", F.length("p").alias("chars"), F.md5(F.col("p").cast("binary")).alias("plain_md5"))


def _plain_sql() -> str:
    x = "text"
    for p, plain in R.PLAIN:
        for a, b in ((p[0], plain), (p[0].upper(), plain[:1].upper() + plain[1:])):
            x = f"regexp_replace({x}, {quote(f'(^|{R.EDGE}){a}(?i:{p[1:]})($|{R.EDGE})')}, '\\1{b}\\2', 'g')"
    return f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"


F19 = f"WITH {TEXTS}, p AS (SELECT doc_id, text, {_plain_sql()} AS p FROM texts) SELECT doc_id, length(p) AS chars, md5(p) AS plain_md5 FROM p WHERE p != text"


def f18(spark, sf_dir):
    return given(spark, sf_dir, REPLIES, "id long, reply string", REPLIES_FROM).select("id", R.clean_reply(F.col("reply")).alias("text"))


F18 = rf"""WITH a AS (SELECT id, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS t FROM {given_sql(REPLIES, REPLIES_FROM, 'id', 'reply')}), b AS (SELECT id, regexp_replace(t, '(?s)^```[a-z]*\n(.*?)\n?```$', '\1') AS t FROM a),
c AS (SELECT id, regexp_replace(t, '(?i)^(?:sure[,!.]?\s*)?(?:here(?:''s| is) (?:the |a |your )?(?:rewritten|revised|paraphrased|edited|simplified|expanded|condensed|shortened)[^\n:]*:)\s*', '') AS t FROM b), d AS (SELECT id, regexp_replace(t, '(?i)^(?:rewritten|revised) (?:passage|text|version):\s*', '') AS t FROM c)
SELECT id, trim(regexp_replace(t, '(?s)^["“]([^"“”]*)["”]$', '\1')) AS text FROM d"""

CASES = ((1, "NASA", "space"), (2, "Hello", "world"), (3, "x", "Y"), (4, "A", "an"))
CASES_FROM = "SELECT doc_id + 100, CASE WHEN doc_id % 3 = 0 THEN upper(replace(split_part(text, ' ', 1), 'ß', 'ss')) ELSE split_part(text, ' ', 2) END, replace(split_part(text, ' ', 3), 'ß', 'ss') FROM {documents} WHERE text IS NOT NULL"  # engines differ in the capital of ß


def f11(spark, sf_dir):
    return given(spark, sf_dir, CASES, "id long, a string, b string", CASES_FROM).select("id", T.match_case(F.col("a"), F.col("b")).alias("text"))


def a28(spark, sf_dir):
    return R.diff_share(_pairs(spark, sf_dir))


QUERIES = {"w21_rewrite_problems": w21, "w23_style_issues": w23, "w24_writing_quality": w24, "a19_most_generic": a19, "f19_plain_wording": f19, "f18_clean_reply": f18, "f11_match_case": f11, "a28_changed_share": a28}
ORACLES = {
    "w21_rewrite_problems": W21, "w23_style_issues": W23, "w24_writing_quality": W24, "a19_most_generic": A19, "f19_plain_wording": F19, "f18_clean_reply": F18,
    "f11_match_case": f"SELECT id, CASE WHEN length(a) > 1 AND a = upper(a) AND a != lower(a) THEN upper(b) WHEN regexp_matches(a, '^[A-Z]') THEN upper(left(b, 1)) || substr(b, 2) ELSE b END AS text FROM {given_sql(CASES, CASES_FROM, 'id', 'a', 'b')}",
}
