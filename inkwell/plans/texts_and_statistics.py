"""Queries on single texts: tokens, preparation, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import LANGUAGE_WORDS
from inkwell.operators import preparing as P
from inkwell.operators import statistics as S
from inkwell.operators.tokens import paragraphs, token_spans, tokens
from inkwell.plans.common import given, given_sql, SENTENCES, STOP, TEXTS, TOKENS, WORDS, quote, sql_normal, sql_raw_words, sql_simple_sentences, sql_unconfuse, texts, values
from inkwell.plans.comparing import sql_stem


def sql_matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, {group})"


def sql_count(text: str, pattern: str) -> str:
    return f"len({sql_matches(text, pattern)})"


def t01(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))


def t01_exact(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(P.exact_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))


def t02(spark, sf_dir):
    return paragraphs(texts(spark, sf_dir))


T02 = rf"""WITH {TEXTS}, p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p != '') AS ps FROM texts)
SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ix, unnest(ps) AS text FROM p"""


def t03(spark, sf_dir):
    return token_spans(texts(spark, sf_dir))


T03 = f"""WITH {TEXTS}, r AS (SELECT doc_id, {sql_raw_words('text')} AS raws, regexp_split_to_array(text, {quote(T.WORD)}) AS gaps FROM texts),
t AS (SELECT doc_id, unnest(raws) AS raw, unnest(gaps[1 : len(raws)]) AS gap, generate_subscripts(raws, 1) - 1 AS pos FROM r),
e AS (SELECT *, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "end" FROM t)
SELECT doc_id, pos, "end" - length(raw) AS "start", "end", raw, {sql_normal('raw')} AS word FROM e"""


def t05(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"))


def t09(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", F.length(P.body(F.col("text"))).alias("body_chars"), F.length("text").alias("chars"))
    return d.where("body_chars < chars or doc_id < 0")


T09 = rf"""WITH {TEXTS}, h AS (SELECT doc_id, text, length(regexp_extract(text, '(?s)^(.*\n)[ \t]*{P.REFERENCE_HEADING}[ \t]*:?[ \t]*\n', 1)) AS n FROM texts),
b AS (SELECT doc_id, CASE WHEN n > 0 AND n >= 0.3 * length(text) THEN n ELSE length(text) END AS body_chars, length(text) AS chars FROM h) SELECT * FROM b WHERE body_chars < chars OR doc_id < 0"""


def t10(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", F.col("text"), P.blank_quotes(F.col("text")).alias("blank"))
    return d.where(F.col("blank") != F.col("text")).select("doc_id", F.md5(F.col("blank").cast("binary")).alias("blanked_md5"), F.length("blank").alias("chars"))


T10 = f"""WITH {TEXTS}, q AS (SELECT doc_id, text, list_filter({sql_matches('text', P.QUOTED)}, lambda q: length(q) >= 40) AS qs FROM texts),
b AS (SELECT doc_id, text, list_reduce(list_prepend(text, qs), lambda t, q: replace(t, q, repeat(' ', length(q)))) AS b FROM q) SELECT doc_id, md5(b) AS blanked_md5, length(b) AS chars FROM b WHERE b != text"""


def t12(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in P.PROTECTED]).where(" + ".join(k for k, _ in P.PROTECTED) + " > 0")


def t13(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", F.length("text").alias("chars"), P.masked(F.col("text")).alias("m"))
    return d.select("doc_id", "chars", F.length("m").alias("masked_chars"), F.md5(F.col("m").cast("binary")).alias("masked_md5"))


T13 = f"""WITH {TEXTS}, m AS (SELECT doc_id, text, regexp_split_to_array(text, {quote(P.ANY_PROTECTED)}) AS gaps, {sql_matches('text', P.ANY_PROTECTED)} AS hits FROM texts),
j AS (SELECT doc_id, length(text) AS chars, array_to_string(list_transform(list_zip(gaps, hits), lambda x: x[1] || coalesce(repeat(chr(1), length(x[2])), '')), '') AS m FROM m)
SELECT doc_id, chars, length(m) AS masked_chars, md5(m) AS masked_md5 FROM j"""

REPLIES = (
    (1, "See {{P1}} and {{ P2 }}.", "a|b", "Rates rose 5 and 7.5%.", "Rates rose 7.5 by 5."),
    (2, "Lost {{P1}} {{P1}} {{P9}}", "x|y|z", "From 12 to 14, then 14.", "From 12 to 15."),
    (3, "Nothing here", "", "No numbers.", "-3 came from nowhere, and 2e5."),
)


#: Each document as an answer that keeps, loses, repeats or invents placeholders and numbers.
REPLIES_FROM = """SELECT doc_id + 100, coalesce(text, '') || ' ' || chr(123) || chr(123) || 'P1' || chr(125) || chr(125) || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(123) || chr(123) || ' P2 ' || chr(125) || chr(125) WHEN 2 THEN chr(123) || chr(123) || 'P1' || chr(125) || chr(125) ELSE chr(123) || chr(123) || 'P7' || chr(125) || chr(125) END, 'one' || CASE WHEN doc_id % 3 = 0 THEN '|two' ELSE '' END,
 coalesce(text, '') || ' 12 of ' || CAST(doc_id % 50 AS STRING), replace(coalesce(text, ''), '2', '3') || ' 12 and ' || CAST(doc_id % 7 AS STRING) FROM {documents}"""


def _replies(spark, sf_dir):
    return given(spark, sf_dir, REPLIES, "id long, output string, spans string, before string, after string", REPLIES_FROM).withColumn("spans", F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", r"\|")))


def t14(spark, sf_dir):
    r = P.restored(F.col("output"), F.col("spans"))
    return _replies(spark, sf_dir).select("id", r.alias("r")).select("id", "r.text", *[F.array_join(F.array_sort(F.col(f"r.{k}")).cast("array<string>"), ",").alias(k) for k in ("missing", "duplicated", "unknown")])


T14 = rf"""WITH r AS (SELECT id, output, CASE WHEN spans = '' THEN []::VARCHAR[] ELSE string_split(spans, '|') END AS spans, list_transform(regexp_extract_all(output, '{P.PLACEHOLDER}', 1), lambda x: x::INT) AS ids FROM {given_sql(REPLIES, REPLIES_FROM, 'id', 'output', 'spans', 'before', 'after')}),
s AS (SELECT *, range(1, len(spans) + 1) AS issued FROM r),
f AS (SELECT *, list_filter(issued, lambda i: NOT list_contains(ids, i)) AS miss, list_filter(issued, lambda i: len(list_filter(ids, lambda j: j = i)) > 1) AS dup, list_sort(list_distinct(list_filter(ids, lambda i: NOT list_contains(issued, i)))) AS unk,
  list_transform(list_zip(regexp_split_to_array(output, '\{{\{{\s*P[0-9]+\s*\}}\}}'), ids), lambda x: x[1] || coalesce(spans[x[2]], '')) AS parts FROM s)
SELECT id, array_to_string(parts, '') AS text, array_to_string(miss, ',') AS missing, array_to_string(dup, ',') AS duplicated, array_to_string(unk, ',') AS unknown FROM f"""


def t15(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(P.numbers(F.col("text")), " ").alias("numbers")).where("numbers != ''")


def t16(spark, sf_dir):
    a, b = P.numbers(F.col("before")), P.numbers(F.col("after"))
    return _replies(spark, sf_dir).select("id", F.array_join(P.multiset_less(a, b), " ").alias("missing"), F.array_join(P.multiset_less(b, a), " ").alias("added"))


def _bag(a: str) -> str:
    return f"SELECT id, x, count(*) AS n FROM (SELECT id, unnest(list_transform({sql_matches(a, P.NUMBER, 1)}, lambda n: replace(n, '−', '-'))) AS x FROM r) GROUP BY id, x"


T16 = f"""WITH r AS (SELECT * FROM {given_sql(REPLIES, REPLIES_FROM, 'id', 'output', 'spans', 'before', 'after')}), a AS ({_bag('before')}), b AS ({_bag('after')}),
d AS (SELECT id, x, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (id, x)), e AS (SELECT id, x, d, unnest(range(abs(d))) AS k FROM d)
SELECT r.id, coalesce((SELECT string_agg(x, ' ' ORDER BY x) FROM e WHERE e.id = r.id AND d > 0), '') AS missing, coalesce((SELECT string_agg(x, ' ' ORDER BY x) FROM e WHERE e.id = r.id AND d < 0), '') AS added FROM r"""


def t18(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", P.is_prose(F.col("text")).alias("is_prose"))


T18 = rf"""WITH {TEXTS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t != '') AS w FROM texts)
SELECT doc_id, len(w) >= 40 AND len(list_filter(w, lambda t: regexp_matches(t, '^[("“]?[A-Za-z][a-z''’-]+[,.;:)"”]*$'))) >= 0.6 * len(w) AS is_prose FROM w"""


def t19(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", P.title(F.col("text")).alias("title")).where("title is not null")


T19 = rf"""WITH {TEXTS}, b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n')[1], chr(10)), lambda x: trim(x)), lambda x: x != '') AS lines FROM texts),
j AS (SELECT doc_id, coalesce(lines[1], '') AS f, CASE WHEN len(lines) <= 3 THEN regexp_replace(array_to_string(lines, ' '), '\s+', ' ', 'g') ELSE coalesce(lines[1], '') END AS j FROM b),
g AS (SELECT doc_id, CASE WHEN length(j) BETWEEN 4 AND 200 AND NOT regexp_matches(j, '[.!?]$') THEN j WHEN length(f) BETWEEN 4 AND 200 AND NOT regexp_matches(f, '[.!?]$') THEN f END AS title FROM j) SELECT * FROM g WHERE title IS NOT NULL"""


def t20(spark, sf_dir):
    from inkwell.operators.integrity import clean

    return texts(spark, sf_dir).select("doc_id", F.col("text"), clean(F.col("text")).alias("c")).where("c != text").select("doc_id", F.md5(F.col("c").cast("binary")).alias("cleaned_md5"), F.length("c").alias("chars"))


def _t20() -> str:
    from inkwell.operators.integrity import DROPPED, ODD_SPACE

    return f"""WITH {TEXTS}, a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '[{DROPPED}]', '', 'g'), '[{ODD_SPACE}]', ' ', 'g') AS t FROM texts),
b AS (SELECT doc_id, text, regexp_split_to_array(t, '[\\p{{L}}\\p{{N}}]+') AS gaps, list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), lambda w: {sql_unconfuse('w')}) AS ws FROM a),
c AS (SELECT doc_id, text, array_to_string(list_transform(list_zip(gaps, ws), lambda x: x[1] || coalesce(x[2], '')), '') AS c FROM b) SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS chars FROM c WHERE c != text"""


def _windows(size, step):
    def run(spark, sf_dir):
        w = F.filter(F.split("text", r"\s+"), lambda t: t != "")
        return texts(spark, sf_dir).select("doc_id", F.posexplode(P.windows(w, size, step)).alias("ix", "w")).select("doc_id", "ix", "w.start", "w.end")

    return run


def _windows_sql(size, step):
    return rf"""WITH {TEXTS}, n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t != '')) AS n FROM texts),
i AS (SELECT doc_id, n, unnest(range(greatest(ceil((n - {size}) / {step}.0)::INT, 0) + 1)) AS ix FROM n WHERE n > 0) SELECT doc_id, ix, ix * {step} AS "start", least(ix * {step} + {size}, n) AS "end" FROM i"""


def t27(spark, sf_dir):
    return P.segments(texts(spark, sf_dir)).select("doc_id", "ix", "words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def t08(spark, sf_dir):
    return P.reflow(texts(spark, sf_dir)).select("doc_id", "block", "ix", T.word_count(F.col("text")).alias("words"))


def t29(spark, sf_dir):
    return S.language(texts(spark, sf_dir))


_FIRST = {code: k for k, (code, _, _) in enumerate(LANGUAGE_WORDS)}
T29 = f"""WITH {TEXTS}, l AS (SELECT code, k, unnest(string_split(ws, ' ')) AS word FROM {values([(c, k, w) for k, (c, _, w) in enumerate(LANGUAGE_WORDS)], 'code', 'k', 'ws')}),
d AS (SELECT doc_id, text, list_transform(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: x) AS w, greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) AS letters FROM texts),
t AS (SELECT doc_id, unnest(w) AS word FROM d), c AS (SELECT doc_id, word, count(*) AS c FROM t GROUP BY ALL),
h AS (SELECT d.doc_id, l.code, l.k, coalesce(sum(c.c), 0) / greatest(any_value(len(w)), 1) AS score FROM d CROSS JOIN l LEFT JOIN c ON c.doc_id = d.doc_id AND c.word = l.word GROUP BY d.doc_id, l.code, l.k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM h), b AS (SELECT a.doc_id, a.code, a.score AS s, z.score AS s2 FROM r a JOIN r z ON z.doc_id = a.doc_id AND z.r = 2 WHERE a.r = 1),
x AS (SELECT d.doc_id, CASE {' '.join(f"WHEN len(regexp_extract_all(text, '[{r}]')) / letters > 0.3 THEN {{'code': '{c}', 'confidence': least(1.0, len(regexp_extract_all(text, '[{r}]')) / letters + 0.2)}}" for c, r in S.SCRIPTS)}
 ELSE CASE WHEN s > 0 THEN {{'code': b.code, 'confidence': least(1.0, (s - s2) / s + 0.3)}} ELSE {{'code': 'en', 'confidence': 0.0}} END END AS l FROM d JOIN b USING (doc_id))
SELECT doc_id, l.code AS code, round(l.confidence, 6) AS confidence FROM x"""


def a08(spark, sf_dir):
    return S.sentence_lengths(texts(spark, sf_dir))


A08 = f"""WITH {TEXTS}, n AS (SELECT doc_id, list_filter(list_transform({sql_simple_sentences('text')}, lambda s: {sql_count('s', T.WORD)}), lambda n: n > 0) AS n FROM texts),
u AS (SELECT doc_id, unnest(n) AS n FROM n)
SELECT a.doc_id, len(a.n)::INT AS sentences, round(coalesce(avg(u.n), 0), 6) AS mean_words, round(coalesce(stddev_samp(u.n), 0), 6) AS sd_words, round(coalesce(stddev_samp(u.n) / avg(u.n), 0), 6) AS cv_words, round(coalesce(median(u.n), 0), 6) AS median_words, coalesce(max(u.n), 0)::INT AS longest
FROM n a LEFT JOIN u USING (doc_id) GROUP BY a.doc_id, a.n"""


def a08_entropy(spark, sf_dir):
    return S.word_entropy(texts(spark, sf_dir))


A08E = f"""WITH {TOKENS}, c AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS words, count(*) AS distinct_words, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY doc_id"""


def w01(spark, sf_dir):
    return S.moving_type_token_ratio(texts(spark, sf_dir))


W01 = f"""WITH {WORDS}, p AS (SELECT doc_id, words, len(words) AS n, unnest(range(greatest(len(words) - 49, 1))) AS p FROM ws WHERE len(words) > 0)
SELECT doc_id, any_value(n) AS words, round(CASE WHEN any_value(n) <= 50 THEN max(len(list_distinct(words))) / any_value(n) ELSE sum(len(list_distinct(words[p + 1 : p + 50]))) / 50 / (any_value(n) - 49) END, 9) AS mattr FROM p GROUP BY doc_id"""


def d05(spark, sf_dir):
    return S.dense_features(texts(spark, sf_dir))


def _d05() -> str:
    toks = f"list_transform({sql_matches(quote_lower('text'), T.FEATURE_TOKEN)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<num>' ELSE t END)"
    rate = lambda p: f"{sql_count('text', p)} / n * 100"
    some = lambda test: f"len(list_filter(w, lambda w: {test})) / n * 100"
    v = {
        "mean_sentence_len": "least(80.0, ml) / 20", "sentence_len_cv": "least(2.0, CASE WHEN len(l) > 1 THEN sqrt(list_sum(list_transform(l, lambda x: (x - ml) * (x - ml))) / (len(l) - 1)) / ml ELSE 0 END)",
        "type_token_50": "CASE WHEN len(w) >= 50 THEN list_sum(list_transform(range(0, len(w) - 49, 25), lambda i: len(list_distinct(w[i + 1 : i + 50])))) / 50 / len(range(0, len(w) - 49, 25)) ELSE len(list_distinct(w)) / n END",
        "comma_rate": rate(","), "semicolon_rate": rate(";"), "colon_rate": rate(":"), "dash_rate": rate(r"[—–]|\s-\s"), "paren_rate": rate(r"\("), "question_rate": rate(r"\?"), "exclaim_rate": rate("!"), "quote_rate": rate('["“”]'),
        "contraction_rate": some(f"regexp_matches(w, {quote(S.CONTRACTED)})"), "first_person_rate": some("w IN ('i', 'my', 'me', 'we', 'our', 'us')"), "second_person_rate": some("w IN ('you', 'your')"), "digit_rate": some("w = '<num>'"),
        "stopword_rate": some(f"w IN {STOP}") + " / 10", "long_word_rate": some("length(w) >= 9"), "mean_word_len": "coalesce(list_sum(list_transform(w, lambda w: length(w))), 0) / n / 5", "paragraph_count_rate": rate(r"\n\s*\n"),
        "capital_start_rate": f"CASE WHEN len(l) > 0 THEN {sql_count('text', r'(?:^|[.!?]\s+)[A-Z]')} / len(l) ELSE 0 END",
    }
    return rf"""WITH {TEXTS}, a AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"“(])', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n\s*\n'), lambda s: {sql_count('s', r'[\p{L}\p{N}]+')}), lambda n: n > 0) AS l,
 list_filter({toks}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}<]')) AS w FROM texts), b AS (SELECT *, greatest(len(w), 1) AS n FROM a), c AS (SELECT *, CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE n::DOUBLE END AS ml FROM b)
SELECT doc_id, {', '.join(f'round({e}, 9) AS {k}' for k, e in v.items())} FROM c"""


def quote_lower(x: str) -> str:
    return f"replace(lower({x}), '’', '''')"


def a17(spark, sf_dir):
    return S.readability(texts(spark, sf_dir))


def sql_syllables(w: str) -> str:
    x = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    bare = f"regexp_replace(regexp_replace({x}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"CASE WHEN {x} = '' THEN 0 WHEN length({x}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({bare}, '[aeiouy]+'))) END"


A17 = f"""WITH {TEXTS}, a AS (SELECT doc_id, {sql_raw_words('text')} AS w, {sql_simple_sentences('text')} AS s FROM texts),
b AS (SELECT *, len(w) / greatest(len(s), 1) AS per, list_sum(list_transform(w, lambda w: greatest(1, {sql_syllables('w')}))) / len(w) AS spw FROM a WHERE len(w) > 0),
c AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * per - 84.6::DOUBLE * spw AS ease, 0.39::DOUBLE * per + 11.8::DOUBLE * spw - 15.59::DOUBLE AS grade FROM b)
SELECT doc_id, len(w)::INT AS words, len(s)::INT AS sentences, list_max(list_transform(s, lambda s: {sql_count('s', T.WORD)})) AS longest, floor(per * 10 + 0.5) / 10 AS avg_sentence, floor(ease * 10 + 0.5) / 10 AS ease, floor(grade * 10 + 0.5) / 10 AS grade,
 floor(len(list_filter(s, lambda s: regexp_matches(' ' || s || ' ', {quote(S.PASSIVE)}))) / greatest(len(s), 1) * 100 + 0.5) / 100 AS passive_share,
 CASE WHEN ease >= 90 THEN 'Very easy' WHEN ease >= 80 THEN 'Easy' WHEN ease >= 70 THEN 'Fairly easy' WHEN ease >= 60 THEN 'Plain English' WHEN ease >= 50 THEN 'Fairly difficult' WHEN ease >= 30 THEN 'Difficult (typical of academic writing)' ELSE 'Very difficult' END AS level FROM c"""


def a26(spark, sf_dir):
    return S.document_statistics(texts(spark, sf_dir))


A26 = rf"""WITH {TEXTS}, a AS (SELECT doc_id, {sql_count('text', T.WORD)} AS n, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '\s', '', 'g') != '')) AS p FROM texts)
SELECT doc_id, n AS words, p AS paragraphs, greatest(1, floor(n / 230 + 0.5))::INT AS reading_minutes FROM a"""


def f01(spark, sf_dir):
    t = tokens(texts(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))
    return t.select("word", "n", T.syllables(F.col("word")).alias("syllables"), T.stem(F.col("word")).alias("stem"))


F01 = f"WITH {TOKENS} SELECT word, count(*) AS n, {sql_syllables('word')} AS syllables, {sql_stem('word')} AS stem FROM tok GROUP BY word"


def f10(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", T.feature_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


F10 = f"""WITH {TEXTS}, t AS (SELECT doc_id, list_transform({sql_matches(quote_lower('text'), T.FEATURE_TOKEN)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<num>' ELSE t END) AS t FROM texts)
SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""


def f06(spark, sf_dir):
    """Stems of content words, most frequent first (a report of 200)."""
    t = tokens(texts(spark, sf_dir)).where((F.length("word") > 2) & ~T.is_stopword(F.col("word")))
    return t.groupBy(T.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("forms")).orderBy(F.desc("n"), "stem").limit(200)


F06 = f"WITH {TOKENS} SELECT {sql_stem('word')} AS stem, count(*) AS n, count(DISTINCT word) AS forms FROM tok WHERE length(word) > 2 AND word NOT IN {STOP} GROUP BY ALL ORDER BY n DESC, stem LIMIT 200"

QUERIES = {
    "t01_simple_sentences": t01, "t01_exact_sentences": t01_exact, "t02_paragraphs": t02, "t03_tokens": t03, "t05_word_count": t05, "t08_reflow": t08, "t09_body": t09, "t10_blank_quotes": t10, "t12_protected_counts": t12, "t13_masked": t13, "t14_restore": t14, "t15_numbers": t15, "t16_numbers_kept": t16,
    "t18_is_prose": t18, "t19_title": t19, "t20_clean": t20, "t25_windows_180": _windows(180, 144), "t26_windows_300": _windows(300, 200), "t27_segments": t27, "t29_language": t29, "a08_sentence_length_stats": a08, "a08_word_entropy": a08_entropy, "w01_mattr": w01, "d05_dense_features": d05, "a17_readability": a17,
    "a26_document_stats": a26, "f01_syllables_stems": f01, "f10_feature_tokens": f10, "f06_content_stems": f06,
}
ORACLES = {
    "t01_simple_sentences": f"WITH {SENTENCES} SELECT doc_id, ix, sentence FROM sen", "t02_paragraphs": T02, "t03_tokens": T03, "t05_word_count": f"WITH {TEXTS} SELECT doc_id, {sql_count('text', T.WORD)} AS words FROM texts", "t09_body": T09, "t10_blank_quotes": T10,
    "t12_protected_counts": f"WITH {TEXTS}, c AS (SELECT doc_id, {', '.join(f'{sql_count("text", p)} AS {k}' for k, p in P.PROTECTED)} FROM texts) SELECT * FROM c WHERE {' + '.join(k for k, _ in P.PROTECTED)} > 0",
    "t13_masked": T13, "t14_restore": T14, "t16_numbers_kept": T16, "t18_is_prose": T18, "t19_title": T19, "t20_clean": _t20(), "t25_windows_180": _windows_sql(180, 144), "t26_windows_300": _windows_sql(300, 200), "t29_language": T29,
    "t15_numbers": f"WITH {TEXTS}, n AS (SELECT doc_id, array_to_string(list_transform({sql_matches('text', P.NUMBER, 1)}, lambda n: replace(n, '−', '-')), ' ') AS numbers FROM texts) SELECT * FROM n WHERE numbers != ''",
    "a08_sentence_length_stats": A08, "a08_word_entropy": A08E, "w01_mattr": W01, "d05_dense_features": _d05(), "a17_readability": A17, "a26_document_stats": A26, "f01_syllables_stems": F01, "f10_feature_tokens": F10, "f06_content_stems": F06,
}
