"""Queries on reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import overlap as O
from inkwell.operators import reports as R
from inkwell.plans.common import TEXTS, given, given_sql, texts, values
from inkwell.plans.comparing import RUNS, _docs, w06
from inkwell.plans.texts_and_statistics import sql_count
from inkwell.tables import table

KINDS = ("copied_uncited", "copied_cited", "disguised", "reworded_uncited", "repeated", "quote_uncited")
ISSUES = tuple((d, KINDS[(d * 7 + i * 3) % 6] if i % 4 else "copied_uncited", i * 10, (d * 13 + i * 11) % 40 + 1) for d in range(1, 6) for i in range(14))
COLS = ("doc_id", "kind", '"start"', "words")
#: An issue for each event, visitors as documents.
ISSUES_FROM = "SELECT user_id + 100, CASE event_id % 6 WHEN 0 THEN 'copied_uncited' WHEN 1 THEN 'copied_cited' WHEN 2 THEN 'disguised' WHEN 3 THEN 'reworded_uncited' WHEN 4 THEN 'repeated' ELSE 'quote_uncited' END, event_id, event_id * 7 % 40 + 1 FROM {events}"


def _issues(spark, sf_dir):
    return given(spark, sf_dir, ISSUES, "doc_id long, kind string, start long, words long", ISSUES_FROM)


def l08(spark, sf_dir):
    return R.action_list(_issues(spark, sf_dir))


L08 = f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY words DESC, "start") AS n FROM {given_sql(ISSUES, ISSUES_FROM, *COLS)} WHERE kind NOT IN ('reworded_cited', 'repeated')),
a AS (SELECT doc_id, CASE WHEN kind IN ('copied_uncited', 'disguised', 'tortured', 'translated') OR (kind = 'copied_cited' AND words >= 15) THEN 'high' ELSE 'medium' END AS level, kind, "start", kind || ': ' || words || ' words' AS title FROM i WHERE n <= 5
 UNION ALL SELECT doc_id, 'medium', 'more', NULL, count(*) || CASE WHEN count(*) = 1 THEN ' more passage to fix' ELSE ' more passages to fix' END FROM i WHERE n > 5 GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, (kind = 'more')::INT, kind, "start") AS place, level, kind, title FROM a"""


def a07(spark, sf_dir):
    return O.issue_breakdown(_issues(spark, sf_dir))


A07 = "SELECT doc_id, " + ", ".join(f"coalesce(sum(CASE WHEN kind = '{k}' THEN {'1' if k == 'quote_uncited' else 'words'} END), 0)::BIGINT AS {k}" for k in O.ISSUES) + f" FROM {given_sql(ISSUES, ISSUES_FROM, *COLS)} GROUP BY doc_id"


def l02(spark, sf_dir):
    """Issues in reading order of a review: by kind, then by words."""
    r = F.row_number().over(O.W.partitionBy("doc_id").orderBy(R.rank_of(F.col("kind"), O.ISSUES), F.desc("words"), "start"))
    return _issues(spark, sf_dir).withColumn("place", r)


L02 = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position([{', '.join(f"'{k}'" for k in O.ISSUES)}], kind), words DESC, "start") AS place FROM {given_sql(ISSUES, ISSUES_FROM, *COLS)}"""
FACTS = (
    (1, 30.0, "high", 0.0, 40, False, "uncertain", 50, 40, 60, 10, 0, 0, 2, 3000, 90, 3, 1), (2, 0.0, "low", 0.0, 0, False, "likely_human", 10, 4, 20, 0, 0, 0, 0, 1500, 70, 1, 0), (3, 12.5, "moderate", 6.0, 0, False, "insufficient_text", 0, 0, 0, 1, 1, 0, 1, 60, 20, 9, 9),
    (4, 1.0, "low", 0.0, 0, True, "likely_ai", 95, 80, 100, 3, 0, 2, 0, 900, 85, 0, 0),
)
FACT_COLS = ("doc_id", "similarity", "verdict", "reworded", "uncited_words", "serious", "ai_verdict", "ai_score", "ai_low", "ai_high", '"references"', "missing", "mismatched", "claims", "words", "grammar_score", "grammar_issues", "grammar_errors")


#: The facts of a report for each order.
FACTS_FROM = """SELECT o_orderkey + 10, floor(o_totalprice % 1000) / 10.0, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END, o_custkey % 12 * 1.0, CAST(o_custkey % 3 * (o_orderkey % 40) AS INT), o_orderkey % 17 = 0, CASE o_orderkey % 4 WHEN 0 THEN 'likely_ai' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'insufficient_text' ELSE 'likely_human' END, CAST(o_custkey % 100 AS INT), CAST(o_custkey % 50 AS INT), CAST(o_custkey % 50 + 50 AS INT), CAST(o_orderkey % 12 AS INT), CAST(o_custkey % 2 AS INT), CASE WHEN o_orderkey % 30 = 29 THEN 1 ELSE 0 END, CAST(o_custkey % 4 AS INT), CAST(o_orderkey * 7 % 4000 AS INT), CAST(o_orderkey * 13 % 101 AS INT), CAST(o_orderkey % 15 AS INT), CAST(o_orderkey % 5 AS INT) FROM {orders}"""


def _facts(spark, sf_dir):
    return given(spark, sf_dir, FACTS, "doc_id long, similarity double, verdict string, reworded double, uncited_words int, serious boolean, ai_verdict string, ai_score int, ai_low int, ai_high int, references int, missing int, mismatched int, claims int, words int, grammar_score int, grammar_issues int, grammar_errors int", FACTS_FROM)


def q02(spark, sf_dir):
    return R.overview(_facts(spark, sf_dir))


Q02 = f"""WITH f AS (SELECT * FROM {given_sql(FACTS, FACTS_FROM, *FACT_COLS)})
SELECT doc_id, 'overlap' AS tool, CASE WHEN verdict = 'high' OR serious THEN 'attention' WHEN verdict = 'moderate' OR reworded >= 5 OR uncited_words > 0 THEN 'review' ELSE 'ok' END AS status, format('{{:.1f}}% of words match', similarity::DOUBLE) || CASE WHEN uncited_words > 0 THEN ' (' || uncited_words || ' words copied without a citation)' ELSE '' END || '.' AS headline FROM f
UNION ALL SELECT doc_id, 'detector', CASE ai_verdict WHEN 'likely_ai' THEN 'attention' WHEN 'uncertain' THEN 'review' WHEN 'insufficient_text' THEN 'skipped' ELSE 'ok' END, CASE WHEN ai_verdict = 'insufficient_text' THEN 'Not enough text to judge.' ELSE 'Pattern score ' || ai_score || ' (plausible range ' || ai_low || ' to ' || ai_high || ').' END FROM f
UNION ALL SELECT doc_id, 'citations', CASE WHEN "references" = 0 AND words >= 1000 THEN 'review' WHEN mismatched > 0 THEN 'attention' WHEN missing > 0 OR claims > 0 THEN 'review' ELSE 'ok' END, CASE WHEN "references" = 0 AND words >= 1000 THEN 'No reference list was found in ' || words || ' words.' ELSE "references" || ' reference' || CASE WHEN "references" = 1 THEN '' ELSE 's' END || ', ' || claims || ' claim' || CASE WHEN claims = 1 THEN '' ELSE 's' END || ' that may need a citation.' END FROM f
UNION ALL SELECT doc_id, 'grammar', CASE WHEN grammar_score >= 85 THEN 'ok' WHEN grammar_score >= 65 THEN 'review' ELSE 'attention' END, grammar_issues || ' issue' || CASE WHEN grammar_issues = 1 THEN '' ELSE 's' END || ' (' || grammar_errors || ' likely error' || CASE WHEN grammar_errors = 1 THEN '' ELSE 's' END || ').' FROM f"""


def io18(spark, sf_dir):
    return R.markdown(R.overview(_facts(spark, sf_dir)), R.action_list(_issues(spark, sf_dir)))


def a21(spark, sf_dir):
    return R.paragraph_stats(_docs(spark, sf_dir).unionByName(texts(spark, sf_dir).where("doc_id < 0")), w06(spark, sf_dir))


A21 = rf"""WITH {RUNS}, t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM (WITH {TEXTS} SELECT * FROM texts WHERE doc_id < 0)), b AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n'), lambda p: {sql_count('p', T.WORD)}) AS ns FROM t),
p AS (SELECT doc_id, unnest(ns) AS words, generate_subscripts(ns, 1) - 1 AS ix FROM b), q AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY ix) - words AS f FROM p), u AS (SELECT DISTINCT doc_id, pos FROM cov), c AS (SELECT q.doc_id, ix, count(*) AS c FROM q JOIN u ON u.doc_id = q.doc_id AND pos >= f AND pos < f + words GROUP BY ALL)
SELECT q.doc_id, q.ix, words, round(coalesce(c, 0) / words, 6) AS copied FROM q LEFT JOIN c USING (doc_id, ix) WHERE words >= 8"""
FINDINGS = ((1, "grammar", 0, 4), (1, "copied", 2, 9), (1, "ai", 2, 30), (1, "grammar", 40, 44), (1, "citation", 50, 53), (2, "grammar", 5, 6), (2, "copied", 1, 3))
FINDINGS_FROM = "SELECT user_id + 100, CASE event_id % 4 WHEN 0 THEN 'grammar' WHEN 1 THEN 'copied' WHEN 2 THEN 'ai' ELSE 'citation' END, event_id, event_id + event_id % 9 + 1 FROM {events}"


def w16(spark, sf_dir):
    return R.numbered(given(spark, sf_dir, FINDINGS, "doc_id long, category string, start long, end long", FINDINGS_FROM))


W16 = f"""SELECT *, CASE WHEN category != 'grammar' THEN count(*) FILTER (category != 'grammar') OVER (PARTITION BY doc_id ORDER BY "start", "end", category ROWS UNBOUNDED PRECEDING) END AS n FROM {given_sql(FINDINGS, FINDINGS_FROM, 'doc_id', 'category', '"start"', '"end"')}"""


def l11(spark, sf_dir):
    s = w06(spark, sf_dir).select("doc_id", "start", (F.col("end") - F.col("start")).alias("words"))
    return R.rewrite_targets(s)


L11 = f"""WITH {RUNS}, u AS (SELECT DISTINCT doc_id, pos FROM cov), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM u), s AS (SELECT doc_id, min(pos) AS "start", count(*) AS words FROM i GROUP BY doc_id, i) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, "start") <= 2"""


def a22(spark, sf_dir):
    """Events as an attempt log: the type is the provider, errors fail."""
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("provider"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("documents"))
    return R.provider_stats(log)


A22 = "SELECT 'user ' || (user_id % 10) AS provider, count(*) AS queries, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'purchase') AS documents FROM events GROUP BY ALL"

QUERIES = {"l08_action_list": l08, "a07_issue_breakdown": a07, "l02_issue_order": l02, "q02_overview": q02, "io18_markdown": io18, "a21_paragraph_stats": a21, "w16_numbered_findings": w16, "l11_rewrite_targets": l11, "a22_provider_stats": a22}
ORACLES = {"l08_action_list": L08, "a07_issue_breakdown": A07, "l02_issue_order": L02, "q02_overview": Q02, "a21_paragraph_stats": A21, "w16_numbered_findings": W16, "l11_rewrite_targets": L11, "a22_provider_stats": A22}
