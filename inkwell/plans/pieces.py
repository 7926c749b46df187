"""Queries on texts in pieces: protected stretches, brackets, plans of paragraphs, chunks and edits, pieces of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import pieces as P
from inkwell.operators.reviewing import basic_tokens
from inkwell.plans.common import TEXTS, quote, texts
from inkwell.plans.reviewing import F21
from inkwell.tables import stored, table

SQL_EDGE = r"\b"


def sql_places(name: str, rows: str, pattern: str) -> str:
    """name(doc_id, s, e, hit): the matches of a pattern in rows (doc_id, text)."""
    p = quote(pattern)
    return f"""{name}0 AS (SELECT doc_id, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}) AS h FROM {rows} WHERE regexp_matches(text, {p})),
{name}1 AS (SELECT doc_id, unnest(h) AS hit, unnest(list_transform(g[: len(h)], lambda x: length(x))) AS gap, generate_subscripts(h, 1) AS k FROM {name}0),
{name} AS (SELECT doc_id, hit, (sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) - length(hit))::BIGINT AS s, (sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM {name}1)"""


def t12(spark, sf_dir):
    return P.protected_spans(texts(spark, sf_dir))


_STREAMS = [(k, p.replace(P._EDGE, SQL_EDGE)) for k, p in P.STREAMS]
T12 = f"""WITH RECURSIVE {TEXTS}, {', '.join(sql_places(f'm{i}_', 'texts', p) for i, (_, p) in enumerate(_STREAMS))},
every AS ({' UNION ALL '.join(f"SELECT doc_id, s, e, {i} AS stream, '{k}' AS kind, hit FROM m{i}_ WHERE e > s" for i, (k, _) in enumerate(_STREAMS))}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, stream) AS n FROM every),
f(doc_id, n, upto, id, took) AS (SELECT doc_id, n, e, 1, true FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.s >= f.upto THEN o.e ELSE f.upto END, f.id + (o.s >= f.upto)::INT, o.s >= f.upto FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
SELECT doc_id, f.id, kind, s AS "start", e AS "end", hit AS text FROM f JOIN o USING (doc_id, n) WHERE took"""


def r05(spark, sf_dir):
    return P.bracket_issues(texts(spark, sf_dir))


R05 = f"""WITH RECURSIVE {TEXTS}, {sql_places('lm', 'texts', P.LIST_MARK)}, {sql_places('ev0', 'texts', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n|[()' + chr(92) + '[' + chr(92) + ']{}“”"]')},
ev1 AS (SELECT doc_id, s, hit, coalesce(sum((length(hit) > 1)::INT) OVER (PARTITION BY doc_id ORDER BY s), 0) AS par FROM ev0),
ev AS (SELECT doc_id, par, s, hit, row_number() OVER (PARTITION BY doc_id, par ORDER BY s) AS n FROM ev1 e WHERE length(hit) = 1 AND hit != '"' AND NOT EXISTS (SELECT 1 FROM lm WHERE lm.doc_id = e.doc_id AND e.s >= lm.s AND e.s < lm.e)),
step AS (SELECT *, CASE hit WHEN ')' THEN '(' WHEN ']' THEN '[' WHEN '}}' THEN '{{' WHEN '”' THEN '“' END AS opener FROM ev),
f(doc_id, par, n, stack, bad, mark) AS (
 SELECT doc_id, par, n, CASE WHEN opener IS NULL THEN [{{'m': hit, 's': s}}] ELSE []::STRUCT(m VARCHAR, s BIGINT)[] END, CASE WHEN opener IS NOT NULL THEN s END, hit FROM step WHERE n = 1
 UNION ALL SELECT x.doc_id, x.par, x.n, CASE WHEN opener IS NULL THEN list_append(stack, {{'m': hit, 's': s}}) WHEN stack[-1].m = opener THEN stack[: len(stack) - 1] ELSE stack END, CASE WHEN opener IS NOT NULL AND (len(stack) = 0 OR stack[-1].m != opener) THEN s END, hit
 FROM f JOIN step x ON x.doc_id = f.doc_id AND x.par = f.par AND x.n = f.n + 1),
rest AS (SELECT doc_id, unnest(stack) AS r FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, par ORDER BY n DESC) = 1),
q AS (SELECT doc_id, par, max(s) AS s FROM ev1 WHERE hit = '"' GROUP BY doc_id, par HAVING count(*) % 2 = 1),
u AS (SELECT doc_id, 'unbalanced-brackets' AS rule, bad AS "start", mark FROM f WHERE bad IS NOT NULL UNION ALL SELECT doc_id, 'unbalanced-brackets', r.s, r.m FROM rest UNION ALL SELECT doc_id, 'unbalanced-quotes', s, '"' FROM q)
SELECT doc_id, rule, "start", "start" + 1 AS "end", mark FROM u"""


def t22(spark, sf_dir):
    """Every text's pieces; their places are compared with plain loops in the tests."""
    return P.planned(texts(spark, sf_dir))


def t23(spark, sf_dir):
    return P.planned_chunks(texts(spark, sf_dir), 600)


def _edited(spark, sf_dir):
    """Texts, their pieces, and a new wording of every third piece worth rewriting."""
    docs = texts(spark, sf_dir)
    plan = stored(P.planned(docs), "plan")
    return docs, plan, plan.where("rewrite and ix % 3 = 0").select("doc_id", "ix", F.concat(F.lit("piece "), F.col("ix").cast("string")).alias("new"))


def t24_rebuilt(spark, sf_dir):
    """All texts put together from their pieces: nothing is lost."""
    docs, plan, _ = _edited(spark, sf_dir)
    return P.rebuilt(docs, plan, spark.createDataFrame([], "doc_id long, ix int, new string"))


def t24_edits(spark, sf_dir):
    return P.paragraph_edits(*_edited(spark, sf_dir))


def _vocabulary(spark, sf_dir):
    """A vocabulary by rule from the benchmark's words: words, single characters, and ends of words of up to four characters."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(basic_tokens(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    letters = w.select(F.explode(F.split("w", "")).alias("c")).where("c != ''").distinct()
    ends = w.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "w").where("k < length(w)").select(F.concat(F.lit("##"), F.expr("right(w, k)")).alias("piece"))
    return w.select(F.col("w").alias("piece")).unionByName(letters.select(F.col("c").alias("piece"))).unionByName(letters.select(F.concat(F.lit("##"), "c").alias("piece"))).unionByName(ends).distinct()


def f21(spark, sf_dir):
    return P.wordpieces(texts(spark, sf_dir), _vocabulary(spark, sf_dir)).select("doc_id", "pos", "token", F.array_join("pieces", " ").alias("pieces"))


def _tokens_of(rows: str) -> str:
    """The tokens of `basic_tokens`, as F21 has them."""
    return F21.split(", t AS ")[1].split(" SELECT doc_id, len")[0].replace("FROM texts)", f"FROM {rows})")


F21_PIECES = f"""WITH RECURSIVE {TEXTS}, t AS {_tokens_of('texts')}, b0 AS (SELECT item_id AS doc_id, text FROM benchmark), b AS {_tokens_of('b0')},
vw AS (SELECT DISTINCT unnest(ts) AS w FROM b), vc AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM vw),
vocab AS (SELECT w AS piece FROM vw UNION SELECT c FROM vc UNION SELECT '##' || c FROM vc UNION SELECT '##' || right(w, k::INT) FROM vw, range(1, 5) r(k) WHERE k < length(w)),
tok AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM t), ws AS (SELECT DISTINCT token FROM tok WHERE length(token) <= 100),
part AS (SELECT token, f, unnest(range(f, length(token) + 1)) AS u FROM (SELECT token, unnest(range(1, length(token) + 1)) AS f FROM ws)),
best AS MATERIALIZED (SELECT token, f, max(u) AS u FROM part JOIN vocab ON piece = CASE WHEN f > 1 THEN '##' ELSE '' END || substring(token, f, u - f + 1) GROUP BY token, f),
g(token, nxt, pieces) AS (SELECT token, 1::BIGINT, ''::VARCHAR FROM ws UNION ALL SELECT g.token, b.u + 1, g.pieces || CASE WHEN f > 1 THEN ' ##' ELSE '' END || substring(g.token, f, b.u - f + 1) FROM g JOIN best b ON b.token = g.token AND b.f = g.nxt),
ok AS (SELECT token, pieces FROM g WHERE nxt = length(token) + 1)
SELECT doc_id, pos, token, coalesce(pieces, '[UNK]') AS pieces FROM tok LEFT JOIN ok USING (token)"""

QUERIES = {"t12_protected_spans": t12, "r05_bracket_stack": r05, "t22_planned": t22, "t23_planned_chunks": t23, "t24_rebuilt": t24_rebuilt, "t24_edits": t24_edits, "f21_wordpieces": f21}
ORACLES = {
    "t12_protected_spans": T12, "f21_wordpieces": F21_PIECES, "r05_bracket_stack": R05,
    "t24_rebuilt": f"WITH {TEXTS} SELECT doc_id, coalesce(text, '') AS text FROM texts",
}
