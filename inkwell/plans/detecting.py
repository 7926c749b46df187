"""Queries on machine-writing patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import CLICHES
from inkwell.operators import detector as D
from inkwell.operators import preparing as P
from inkwell.operators import scoring as V
from inkwell.plans.common import SENTENCES, STOP, TEXTS, given, given_sql, quote, sql_simple_sentences, texts, values
from inkwell.plans.texts_and_statistics import W01, quote_lower, sql_count, sql_matches
from inkwell.tables import stored, table

LOWER = quote_lower("text")
FULL = D.CLICHE + r"(?:[^A-Za-z0-9_]|$)"
WEIGHT = f"CASE WHEN p IN ({', '.join(quote(p) for p, w in CLICHES if w == 3)}) THEN 3 WHEN p IN ({', '.join(quote(p) for p, w in CLICHES if w == 2)}) THEN 2 ELSE 1 END"


def d02(spark, sf_dir):
    c = texts(spark, sf_dir).select("doc_id", F.explode(D.cliches(F.coalesce("text", F.lit("")))).alias("phrase"))
    return c.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def d03(spark, sf_dir):
    s = texts(spark, sf_dir).select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "s"))
    return s.select("doc_id", "ix", D.opener(F.col("s")).alias("opener")).where("opener != ''")


def d04(spark, sf_dir):
    return D.signals(texts(spark, sf_dir))


def sql_ramp(x, x0, y0, x1, y1):
    return f"({y0} + least(1.0, greatest(0.0, ({x} - {x0}) / ({x1} - {x0})::DOUBLE)) * ({y1} - ({y0})))"


def sql_half_up(x, digits):
    return f"floor(({x}) * 1{'0' * digits} + 0.5) / 1{'0' * digits}.0::DOUBLE"


LEANS = {
    "burstiness": sql_half_up(sql_ramp("length_cv", 0.22, 1, 0.62, -1), 2),
    "lexical_diversity": sql_half_up(f"CASE WHEN mattr < 0.7 THEN {sql_ramp('mattr', 0.6, 0.6, 0.7, 0)} ELSE {sql_ramp('mattr', 0.7, 0, 0.82, -0.6)} END", 2),
    "cliches": sql_half_up(f"CASE WHEN per_1000 <= 2 THEN {sql_ramp('per_1000', 0, -0.4, 2, 0)} ELSE {sql_ramp('per_1000', 2, 0, 9, 1)} END", 2),
    "transitions": sql_half_up(f"CASE WHEN opened <= 0.12 THEN {sql_ramp('opened', 0.03, -0.5, 0.12, 0)} ELSE {sql_ramp('opened', 0.12, 0, 0.32, 1)} END", 2),
}
D04 = f"""WITH mat AS ({W01}), {TEXTS},
a AS (SELECT doc_id, {sql_simple_sentences('text')} AS s, {sql_matches(LOWER, FULL, 1)} AS c, {sql_count('text', T.WORD)} AS n FROM texts),
b AS (SELECT *, list_filter(list_transform(s, lambda s: {sql_count('s', T.WORD)}), lambda n: n >= 4) AS l FROM a), m AS (SELECT *, list_avg(l) AS m FROM b),
d AS (SELECT doc_id, n AS words, CASE WHEN len(l) >= 3 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / (len(l) - 1)) / m ELSE 0.45::DOUBLE END AS length_cv,
 CASE WHEN n > 0 THEN coalesce(list_sum(list_transform(c, lambda p: {WEIGHT})), 0) / n * 1000 ELSE 0.0::DOUBLE END AS per_1000,
 CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda s: regexp_extract(lower(s), {quote(D.OPENER)}, 1) != '')) / len(s) ELSE 0.0::DOUBLE END AS opened FROM m),
e AS (SELECT d.*, coalesce(mat.mattr, 0.0) AS mattr FROM d LEFT JOIN mat USING (doc_id)),
f AS (SELECT *, {', '.join(f'{x} AS lean_{k}' for k, x in LEANS.items())} FROM e)
SELECT doc_id, words, round(length_cv, 6) AS length_cv, mattr, round(per_1000, 6) AS per_1000, round(opened, 6) AS opened, {', '.join(f'lean_{k}' for k in LEANS)},
 round(100 / (1 + exp(-3 * (({' + '.join(f'lean_{k} * {w}::DOUBLE' for k, w in D.SIGNAL_WEIGHTS.items())}) / {sum(D.SIGNAL_WEIGHTS.values())}))), 4) AS score FROM f"""


def d06(spark, sf_dir):
    f = D.feature_sums(texts(spark, sf_dir))
    return f.select("doc_id", "features", "h_sum", F.round("checksum", 4).alias("checksum"), F.round("norm", 6).alias("norm"))


FEATURES = f"""t AS (SELECT doc_id, list_transform({sql_matches(LOWER, T.FEATURE_TOKEN)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<num>' ELSE t END) AS t FROM texts),
s AS (SELECT *, list_transform(t, lambda x: CASE WHEN x IN {STOP} OR NOT regexp_matches(x, '\\p{{L}}') THEN x ELSE '_' END) AS s FROM t),
k AS (SELECT doc_id, unnest(list_transform(t, lambda a: 'u:' || a) || list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || ' ' || t[i + 1]) || list_filter(list_transform(range(1, len(t) - 1), lambda i: 'f:' || s[i] || ' ' || s[i + 1] || ' ' || s[i + 2]), lambda f: f != 'f:_ _ _')) AS key FROM s),
kc AS (SELECT doc_id, key, count(*) AS c FROM k GROUP BY ALL), ku AS (SELECT DISTINCT key FROM kc),
kh AS (SELECT key, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(key, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: ((xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::HUGEINT)::BIGINT & 262143 AS h FROM ku),
c AS (SELECT doc_id, h, sum(c)::BIGINT AS c FROM kc JOIN kh USING (key) GROUP BY ALL), fv AS (SELECT doc_id, h, ln(1 + c) / sqrt(sum(ln(1 + c) * ln(1 + c)) OVER (PARTITION BY doc_id)) AS value FROM c)"""


def m03(spark, sf_dir):
    """Feature keys of our own, and the pair of first words of each document."""
    return given(spark, sf_dir, [(k,) for k in KEYS], "s string", KEYS_FROM).distinct().select("s", T.fnv18(F.col("s")).alias("h"))


KEYS_FROM = "SELECT 'b:' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM {documents} WHERE text IS NOT NULL"
KEYS = ("", "u:the", "b:of the", "f:the _ of", "u:ü", "u:<num>")


#: Labels meet their documents by broadcast up to so many (16 MB), beyond that both are shuffled.
BROADCAST_ROWS = 1_000_000


def fitted(spark, sf_dir):
    """h, w: log odds of a feature among labelled documents of low quality against the others, one added to each count.

    A model that SQL can give too; `corpora.train` fits a regression to the same features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    y = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("y"))
    n = y.agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"))
    if V.single(docs):
        few = sum(n.first()) <= BROADCAST_ROWS
        c = V.label_counts(docs, F.broadcast(y) if few else y)
    else:
        c = D.hashed_features(docs).select("doc_id", "h").join(y, "doc_id").groupBy("h").agg(F.count_if("y").alias("c1"), F.count_if(~F.col("y")).alias("c0"))
    w = F.log((F.col("c1") + 1) / (F.col("n1") + 2)) - F.log((F.col("c0") + 1) / (F.col("n0") + 2))
    return stored(c.crossJoin(F.broadcast(n)).select("h", F.round(w, 6).alias("w")), "weights")


FITTED = f"""y AS (SELECT doc_id, quality = 0 AS y FROM labels WHERE quality IS NOT NULL), yn AS (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM y),
wt AS MATERIALIZED (WITH texts AS (SELECT doc_id, text FROM documents), {FEATURES} SELECT h, round(ln((count(*) FILTER (y) + 1) / (n1 + 2)) - ln((count(*) FILTER (NOT y) + 1) / (n0 + 2)), 6) AS w FROM fv JOIN y USING (doc_id), yn GROUP BY h, n1, n0)"""
BIAS = -0.1


def scored(pieces, weights):
    """pieces (doc_id, ix, text) with probability: what the model gives for each, 0.5 where there is no feature."""
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("ix").cast("string"))
    p = D.model_probability(D.hashed_features(pieces.select(key.alias("doc_id"), "text")), weights, BIAS).select(F.col("doc_id").alias("_key"), "probability")
    return pieces.join(p, key == F.col("_key"), "left").withColumn("probability", F.coalesce(F.round("probability", 4), F.lit(0.5))).drop("_key")


def sql_scored(name: str, pieces: str) -> str:
    """name(doc_id, ix, probability) of pieces (doc_id, ix, text)."""
    return f"""{name}_z AS MATERIALIZED (WITH texts AS (SELECT doc_id || ':' || ix AS doc_id, text FROM {pieces}), {FEATURES} SELECT doc_id AS id, 1 / (1 + exp(-(sum(value * coalesce(w, 0)) - 0.1::DOUBLE))) AS p FROM fv LEFT JOIN wt USING (h) GROUP BY doc_id),
{name} AS (SELECT doc_id, ix, coalesce(round(p, 4), 0.5) AS probability FROM {pieces} LEFT JOIN {name}_z ON id = doc_id || ':' || ix)"""


def d07(spark, sf_dir):
    p = D.text_probability(texts(spark, sf_dir), fitted(spark, sf_dir), BIAS)
    return p.select("doc_id", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"))


def d09(spark, sf_dir):
    return D.top_contributors(texts(spark, sf_dir), fitted(spark, sf_dir))


D09 = f"""WITH {TEXTS}, t AS (SELECT doc_id, list_transform({sql_matches(LOWER, T.FEATURE_TOKEN)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<num>' ELSE t END) AS t FROM texts),
p AS (SELECT DISTINCT doc_id, unnest(list_filter(t, lambda a: regexp_full_match(a, '\\p{{L}}{{3,}}')) || list_transform(list_filter(range(1, len(t)), lambda i: regexp_matches(t[i], '^\\p{{L}}') AND regexp_matches(t[i + 1], '^\\p{{L}}')), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM t),
u AS (SELECT DISTINCT phrase, CASE WHEN contains(phrase, ' ') THEN 'b:' ELSE 'u:' END || phrase AS key FROM p),
kh AS (SELECT phrase, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(key, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: ((xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::HUGEINT)::BIGINT & 262143 AS h FROM u),
{FITTED} SELECT doc_id, phrase, round(w, 2) AS weight FROM p JOIN kh USING (phrase) JOIN wt USING (h) WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, phrase) <= 8"""


def _blank_words():
    return F.filter(F.split(F.coalesce("text", F.lit("")), T.re2(r"\s+")), lambda t: t != "")


def _window_probabilities(spark, sf_dir):
    """Windows of 300 words with the probability that the fitted model gives each."""
    docs, weights = texts(spark, sf_dir), fitted(spark, sf_dir)
    if V.single(docs):
        return V.scored_windows(V.by_words(docs, _blank_words()), 300, 200, V.vector(weights), BIAS)
    x = docs.select("doc_id", _blank_words().alias("w")).select("doc_id", "w", F.size("w").alias("words"), F.posexplode(P.windows(F.col("w"), 300, 200)).alias("ix", "at"))
    x = x.select("doc_id", "words", "ix", "at.start", "at.end", F.array_join(F.slice("w", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")), " ").alias("text"))
    return scored(x, weights).drop("text")


WINDOWS = rf"""{FITTED}, nw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t != '') AS w FROM texts), n AS (SELECT doc_id, len(w) AS words FROM nw),
i AS (SELECT doc_id, w, len(w) AS words, unnest(range(greatest(ceil((len(w) - 300) / 200.0)::INT, 0) + 1)) AS ix FROM nw WHERE len(w) > 0),
wx AS (SELECT doc_id, words, ix, ix * 200 AS "start", least(ix * 200 + 300, words) AS "end", array_to_string(w[ix * 200 + 1 : least(ix * 200 + 300, words)], ' ') AS text FROM i), {sql_scored('ws_', 'wx')},
wp AS (SELECT wx.doc_id, words, ix, "start", "end", probability FROM wx JOIN ws_ USING (doc_id, ix))"""


def d12(spark, sf_dir):
    return D.document_verdict(_window_probabilities(spark, sf_dir))


VERDICT = f"CASE WHEN words < 80 THEN 'insufficient_text' WHEN p >= CASE WHEN words >= 150 THEN {D.LIKELY_AI} ELSE {D.LIKELY_AI_SHORT} END THEN 'likely_ai' WHEN p <= {D.LIKELY_HUMAN} THEN 'likely_human' ELSE 'uncertain' END"
D12 = f"""WITH {TEXTS}, {WINDOWS}, g AS (SELECT doc_id, sum(probability * ("end" - "start")) / sum("end" - "start") AS p, coalesce(stddev_samp(probability), 0) AS spread, max(words) AS words FROM wp GROUP BY doc_id),
h AS (SELECT *, least(45, greatest(4, least(40, greatest(4, 10 * sqrt(300 / greatest(words, 1)))) + spread * 25)) AS half FROM g)
SELECT doc_id, floor(round(p * 100, 9) + 0.5)::INT AS score, floor(round(least(100, greatest(0, p * 100 - half)), 9) + 0.5)::INT AS low, floor(round(least(100, greatest(0, p * 100 + half)), 9) + 0.5)::INT AS high, {VERDICT} AS verdict FROM h"""


def d10(spark, sf_dir):
    return D.sentence_scores(texts(spark, sf_dir))


D10 = f"""WITH {SENTENCES}, s0 AS (SELECT doc_id, ix, sentence AS s, {sql_count('sentence', T.WORD)} AS words FROM sen), s1 AS (SELECT * FROM s0 WHERE words > 0),
s2 AS (SELECT *, CASE WHEN words >= 4 THEN words END AS l FROM s1),
s3 AS (SELECT *, count(l) OVER w AS n, coalesce(stddev_samp(l) OVER w, 0) / avg(l) OVER w AS spread, coalesce(avg(l) OVER (PARTITION BY doc_id), 1) AS av FROM s2 WINDOW w AS (PARTITION BY doc_id ORDER BY ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s4 AS (SELECT doc_id, ix, least(1.2, coalesce(list_sum(list_transform({sql_matches(quote_lower('s'), FULL, 1)}, lambda p: {WEIGHT})), 0) * 0.35) + CASE WHEN regexp_extract(lower(s), {quote(D.OPENER)}, 1) != '' THEN 0.35 ELSE 0 END
 + CASE WHEN n >= 4 AND spread < 0.15 THEN 0.3 WHEN n >= 4 AND spread > 0.5 THEN -0.2 ELSE 0 END + CASE WHEN words <= 6 AND words < av * 0.4 THEN -0.25 ELSE 0 END
 + CASE WHEN regexp_matches(' ' || s || ' ', '[?!] $|[^A-Za-z0-9_](?:I|my|we''ve|I''m|I''ve)[^A-Za-z0-9_]') THEN -0.15 ELSE 0 END AS lean FROM s3),
s5 AS (SELECT *, 0.7 * lean + 0.15 * coalesce(lag(lean) OVER w, lean) + 0.15 * coalesce(lead(lean) OVER w, lean) AS sm FROM s4 WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
s6 AS (SELECT doc_id, ix, floor(round(1 / (1 + exp(-(sm * 2.2 - 0.9))), 9) * 100 + 0.5) / 100 AS score FROM s5) SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM s6"""

QUANTILES = (0.05, 0.08, 0.12, 0.2, 0.35, 0.5, 0.7, 0.8, 0.88)
SCORES = tuple((d, s, m, round(((d * 37 + s * 11 + m * 5) % 100) / 100, 2)) for d in range(1, 7) for s in range(1, 9) for m in (1, 2) if (d, s) != (3, 2)) + tuple((9, s, 1, 0.9) for s in range(1, 8))
SEGMENTS = tuple((d, s, 60 + 30 * s, round(((d * 13 + s * 7) % 50) / 50, 2)) for d in (*range(1, 7), 9) for s in range(1, 9))


#: Eight events in a row are the segments of a document, their values its scores by two models.
SEGMENTS_FROM = "SELECT CAST(floor(event_id / 8) AS BIGINT) + 100, CAST(event_id % 8 AS INT), CAST(60 + event_id % 300 AS INT), event_id * 13 % 50 / 50.0 FROM {events}"
SCORES_FROM = "SELECT CAST(floor(event_id / 8) AS BIGINT) + 100, CAST(event_id % 8 AS INT), 1, event_id * 37 % 100 / 100.0 FROM {events} WHERE event_id % 9 > 0 UNION ALL SELECT CAST(floor(event_id / 8) AS BIGINT) + 100, CAST(event_id % 8 AS INT), 2, CASE WHEN event_id % 5 = 0 THEN 0.95 ELSE user_id % 90 / 100.0 END FROM {events}"


def d14(spark, sf_dir):
    seg = given(spark, sf_dir, SEGMENTS, "doc_id long, segment int, words int, probability double", SEGMENTS_FROM)
    sc = given(spark, sf_dir, SCORES, "doc_id long, segment int, model int, score double", SCORES_FROM).withColumn("quantiles", F.array(*[F.lit(q) for q in QUANTILES]))
    return D.merge_neural(seg, sc)


def sql_percentile(p: str) -> str:
    q, c = QUANTILES, D.PERCENTILES
    parts = [f"WHEN {p} >= {q[-1]} THEN {c[-1]} + ({p} - {q[-1]}) / (1 - {q[-1]}) * (1 - {c[-1]})"]
    parts += [f"WHEN {p} {'>' if j == 0 else '>='} {q[j]} THEN {c[j]} + ({p} - {q[j]}) / ({q[j + 1]} - {q[j]}) * ({c[j + 1]} - {c[j]})" for j in reversed(range(len(q) - 1))]
    return f"CASE {' '.join(parts)} ELSE {c[0]} * {p} / {q[0]} END"


D14 = f"""WITH seg AS (SELECT * FROM {given_sql(SEGMENTS, SEGMENTS_FROM, 'doc_id', 'segment', 'words', 'probability')}), sc AS (SELECT * FROM {given_sql(SCORES, SCORES_FROM, 'doc_id', 'segment', 'model', 'score')}),
m AS (SELECT doc_id, segment, model, avg(score)::DOUBLE AS m FROM sc GROUP BY ALL), p AS (SELECT *, ({sql_percentile('m')})::DOUBLE AS pct FROM m),
n AS (SELECT *, CASE WHEN m >= {QUANTILES[-1]} THEN {D.LIKELY_AI} + (m - {QUANTILES[-1]}) / (1 - {QUANTILES[-1]}) * (1 - {D.LIKELY_AI}) WHEN pct <= 0.8 THEN pct / 0.8 * 0.15 ELSE 0.15 + power((pct - 0.8) / ({D.PERCENTILES[-1]} - 0.8), 2) * ({D.LIKELY_AI} - 0.15) END AS neural FROM p),
g AS (SELECT doc_id, segment, max(pct) AS pct, max(neural) AS neural FROM n GROUP BY ALL),
s AS (SELECT seg.*, pct, neural, count(pct) OVER d >= 6 AND count(CASE WHEN pct >= 0.9 THEN 1 END) OVER d >= 0.55 * count(pct) OVER d AS document_level FROM seg LEFT JOIN g USING (doc_id, segment) WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, segment, words, round(CASE WHEN pct IS NULL THEN probability WHEN document_level AND pct >= 0.8 THEN greatest(probability, 0.94) WHEN neural < {D.LIKELY_AI} THEN probability ELSE floor(round(greatest(probability, neural), 9) * 1000 + 0.5) / 1000 END, 6)::DOUBLE AS probability, document_level FROM s"""


def d15(spark, sf_dir):
    docs = texts(spark, sf_dir)
    if V.single(docs):
        bars = (D.LIKELY_AI, D.LIKELY_AI_SHORT, D.LIKELY_HUMAN)
        b = D.percents(V.shares(V.by_words(docs, _blank_words()), 300, 200, V.vector(fitted(spark, sf_dir)), BIAS, 120, bars))
    else:
        tok = docs.select("doc_id", F.posexplode(_blank_words()).alias("pos", "w")).select("doc_id", "pos", F.floor(F.col("pos") / 120).alias("block"))
        parts = _window_probabilities(spark, sf_dir).select("doc_id", F.col("start").alias("first"), (F.col("end") - 1).alias("last"), (F.col("end") - F.col("start")).alias("words"), "probability")
        b = D.breakdown(tok, parts)
    return b.withColumn("label", D.share_label(F.col("ai_percent")))


D15 = rf"""WITH {TEXTS}, {WINDOWS}, tk AS (SELECT doc_id, unnest(range(words)) AS pos FROM n),
c AS (SELECT t.doc_id, t.pos, t.pos // 120 AS block, avg(probability) AS p, min("end" - "start") AS w FROM tk t JOIN wp ON wp.doc_id = t.doc_id AND t.pos >= "start" AND t.pos < "end" GROUP BY ALL),
k AS (SELECT *, CASE WHEN p >= CASE WHEN w >= 150 THEN {D.LIKELY_AI} ELSE {D.LIKELY_AI_SHORT} END THEN 'ai' WHEN p <= {D.LIKELY_HUMAN} THEN 'human' ELSE 'uncertain' END AS kind FROM c),
o AS (SELECT *, NOT coalesce(lag(kind) OVER w = kind AND lag(block) OVER w = block, false) AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, count(*) AS words, count(*) FILTER (kind = 'ai') AS ai, count(*) FILTER (kind = 'human') AS human, count(*) FILTER (kind = 'ai' AND opens) AS ai_passages FROM o GROUP BY doc_id),
r AS (SELECT *, floor(ai * 1000 / words + 0.5) / 10 AS ai_percent, floor(human * 1000 / words + 0.5) / 10 AS human_percent FROM g)
SELECT doc_id, ai_percent, round(greatest(0, 100 - ai_percent - human_percent), 1) AS uncertain_percent, human_percent, words, ai_passages, CASE WHEN ai_percent > 0 AND ai_percent < 20 THEN '*%' ELSE floor(ai_percent + 0.5)::INT || '%' END AS label FROM r"""

QUERIES = {"d02_cliches": d02, "d03_openers": d03, "d04_signals": d04, "d06_hashed_features": d06, "m03_fnv": m03, "d07_model_probability": d07, "d09_top_contributors": d09, "d12_verdict": d12, "d10_sentence_scores": d10, "d14_neural_merge": d14, "d15_breakdown": d15}
ORACLES = {
    "d02_cliches": f"WITH {TEXTS}, c AS (SELECT doc_id, unnest({sql_matches(LOWER, FULL, 1)}) AS phrase FROM texts) SELECT doc_id, phrase, count(*) AS n FROM c GROUP BY ALL",
    "d03_openers": f"WITH {SENTENCES}, o AS (SELECT doc_id, ix, regexp_extract(lower(sentence), {quote(D.OPENER)}, 1) AS opener FROM sen) SELECT * FROM o WHERE opener != ''",
    "d04_signals": D04, "d09_top_contributors": D09, "d12_verdict": D12, "d10_sentence_scores": D10, "d14_neural_merge": D14, "d15_breakdown": D15,
    "d06_hashed_features": f"WITH {TEXTS}, {FEATURES} SELECT doc_id, count(*) AS features, sum(h)::BIGINT AS h_sum, round(sum(value * (h % 97)), 4) AS checksum, round(sum(value * value), 6) AS norm FROM fv GROUP BY doc_id",
    "d07_model_probability": f"WITH {TEXTS}, {FEATURES}, {FITTED}, z AS (SELECT doc_id, sum(value * coalesce(w, 0)) - 0.1 AS z FROM fv LEFT JOIN wt USING (h) GROUP BY doc_id) SELECT doc_id, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS probability FROM z",
    "m03_fnv": f"SELECT s, CASE WHEN s = '' THEN 40389 ELSE list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(s, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: ((xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::HUGEINT)::BIGINT & 262143 END AS h FROM (SELECT DISTINCT s FROM {given_sql([(k,) for k in KEYS], KEYS_FROM, 's')})",
}
