"""Queries on grammar and style rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import ACRONYMS
from inkwell.operators import grammar as G
from inkwell.operators import preparing as P
from inkwell.operators import statistics as S
from inkwell.plans.common import given, given_sql, TEXTS, quote, sql_raw_words, sql_simple_sentences, sql_words, texts, values
from inkwell.plans.texts_and_statistics import sql_count, sql_matches

CHECKED = f"""{TEXTS}, mk AS (SELECT doc_id, regexp_split_to_array(text, {quote(P.ANY_PROTECTED)}) AS gaps, {sql_matches('text', P.ANY_PROTECTED)} AS hits FROM texts),
ck AS (SELECT doc_id, array_to_string(list_transform(list_zip(gaps, hits), lambda x: x[1] || coalesce(repeat(chr(1), length(x[2])), '')), '') AS text FROM mk)"""


def sql_found(name: str, pattern: str, source: str = "ck") -> str:
    p = quote(pattern)
    return f"""{name}0 AS (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM {source} WHERE regexp_matches(text, {p})),
{name}1 AS (SELECT doc_id, gaps, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM {name}0),
{name}2 AS (SELECT doc_id, i, hit, length(gaps[i]) AS g, right(coalesce(CASE WHEN i > 1 THEN hits[i - 1] END, '') || gaps[i], 12) AS before, left(gaps[i + 1] || coalesce(hits[i + 1], ''), 12) AS after FROM {name}1),
{name}3 AS (SELECT *, sum(g + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "end" FROM {name}2),
{name} AS (SELECT doc_id, "end" - length(hit) AS "start", "end", hit, before, after FROM {name}3)"""


def sql_issue(rule: str, source: str, where: str, suggestion: str = "NULL", start: str = '"start"', end: str = '"end"') -> str:
    category, severity = G.RULES[rule]
    return f"SELECT doc_id, '{rule}' AS rule, '{category}' AS category, '{severity}' AS severity, ({start})::BIGINT AS \"start\", ({end})::BIGINT AS \"end\", {suggestion} AS suggestion FROM {source} WHERE {where}"


def _issues(*parts):
    def run(spark, sf_dir):
        text = G.checked(texts(spark, sf_dir))
        out = parts[0](text)
        for p in parts[1:]:
            out = out.unionByName(p(text))
        return out

    return run


TOK = f"""r AS (SELECT doc_id, {sql_raw_words('text')} AS raws, regexp_split_to_array(text, {quote(T.WORD)}) AS gaps FROM ck),
t0 AS (SELECT doc_id, unnest(raws) AS raw, unnest(gaps[1 : len(raws)]) AS gap, generate_subscripts(raws, 1) - 1 AS pos FROM r),
tk AS (SELECT doc_id, pos, raw, gap, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "end" FROM t0)"""
ALLOWED = ", ".join(quote(a) for a in G.ALLOWED)
ABBR = "(" + ", ".join(quote(a) for a in P.ABBREVIATIONS) + ")"
R01 = rf"""WITH {CHECKED}, {TOK}, l AS (SELECT *, lag(raw) OVER w AS last, lag("end") OVER w AS e FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
{sql_issue('repeated-word', 'l', rf"lower(last) = lower(raw) AND regexp_full_match(raw, '[\p{{L}}'']{{2,}}') AND lower(last) || ' ' || lower(raw) NOT IN ({ALLOWED}) AND regexp_full_match(gap, '[ \t]+')", 'last', 'e - length(last)')}"""
R02 = rf"""WITH {CHECKED}, {sql_found('a', r'[ \t]{2,}')}, {sql_found('b', ' +[,;:!?.]')}, {sql_found('c', '[,;]')}, {sql_found('d', '[.]')}
{sql_issue('double-space', 'a', r"regexp_matches(before, '\S$') AND regexp_matches(after, '^\S')", "' '")}
UNION ALL {sql_issue('space-before-punctuation', 'b', r"regexp_matches(before, '[\p{L}\p{N})\]\x01]$') AND regexp_matches(after, '^(?:\s|$)')", 'trim(hit)')}
UNION ALL {sql_issue('missing-space-after-punctuation', 'c', r"regexp_matches(before, '\p{L}{2}$') AND regexp_matches(after, '^\p{L}')", "hit || ' '")}
UNION ALL {sql_issue('missing-space-after-punctuation', 'd', f"regexp_matches(before, '[a-z]{{2}}$') AND regexp_matches(after, '^[A-Z][a-z]') AND lower(regexp_extract(before, '([A-Za-z]+)$', 1)) NOT IN {ABBR}", "'. '")}"""


def _odd(a, b):
    return f"{sql_count('text', a)} != {sql_count('text', b)}"


PARAS = r"""pr AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p != '') AS ps FROM ck),
pa AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS ix FROM pr)"""
R05 = rf"""WITH {CHECKED}, {PARAS}, p AS (SELECT doc_id, ix, regexp_replace(text, '(?m)^[ \t]*(?:[0-9]+|[a-zA-Z])\)', '', 'g') AS text FROM pa)
{sql_issue('unbalanced-brackets', 'p', ' OR '.join(_odd(a, b) for a, b in ((r'\(', r'\)'), (r'\[', r'\]'), (r'\{', r'\}'), ('“', '”'))), start='ix', end='ix + 1')}
UNION ALL {sql_issue('unbalanced-quotes', 'p', sql_count('text', '"') + ' % 2 = 1', start='ix', end='ix + 1')}"""
R06 = rf"""WITH {CHECKED}, {sql_found('a', r"[A-Za-z]{3,}[.!?]\s+[a-z][a-z']*")}, w AS (SELECT *, regexp_extract(hit, '([a-z'']+)$', 1) AS word FROM a)
{sql_issue('sentence-capital', 'w', f"word IN ({', '.join(quote(s) for s in G.STARTERS)}) AND lower(regexp_extract(hit, '^([A-Za-z]+)', 1)) NOT IN {ABBR}", 'upper(left(word, 1)) || substr(word, 2)', '"end" - length(word)')}"""
VOWEL = """CASE WHEN regexp_full_match(word, '[A-Z]{2,}') THEN CASE WHEN regexp_matches(word, '[AEIOU]') THEN NULL ELSE contains('AEFHILMNORSX', left(word, 1)) END WHEN regexp_full_match(word, '[A-Z]') THEN contains('AEFHILMNORSX', word) WHEN regexp_matches(word, '[0-9]') THEN NULL
WHEN regexp_matches(word, '(?i)^(?:hour|honest|honor|honour|heir|x-)') THEN true WHEN regexp_matches(word, '(?i)^(?:one|once|ouija|eu|ewe|uni(?:[^mn]|$)|use|usu|uti|ubiq|ukr|uran|ural|uter|urin|urol|urea)') THEN false ELSE regexp_matches(word, '(?i)^[aeiou]') END"""
CASED = "CASE WHEN length({a}) > 1 AND {a} = upper({a}) AND {a} != lower({a}) THEN upper({b}) WHEN regexp_matches({a}, '^[A-Z]') THEN upper(left({b}, 1)) || substr({b}, 2) ELSE {b} END"
R07 = rf"""WITH {CHECKED}, {sql_found('a', r"(?i)an?\s+[a-z][a-z'-]*")}, w AS (SELECT *, regexp_extract(hit, '(?i)^(an?)\s', 1) AS article, regexp_extract(hit, '(?i)([a-z][a-z''-]*)$', 1) AS word FROM a WHERE NOT regexp_matches(before, '[A-Za-z0-9_]$')),
v AS (SELECT *, {VOWEL} AS vowel FROM w WHERE NOT regexp_full_match(word, '[a-z]')), x AS (SELECT *, CASE WHEN vowel THEN 'an' ELSE 'a' END AS want FROM v)
{sql_issue('a-an', 'x', "vowel != (lower(article) = 'an')", CASED.format(a='article', b='want'), end='"start" + length(article)')}"""


def _confused(rules, rule, name):
    fixed = "CASE " + " ".join(f"WHEN regexp_matches(hit, {quote(f'(?i)^(?:{p})$')}) THEN regexp_replace(hit, {quote(f'(?i)^(?:{p})$')}, {quote(r.replace('$', chr(92)))})" for p, r in rules) + " END"
    return f"{sql_found(name, '(?i)(?:' + '|'.join(p for p, _ in rules) + ')')}, {name}f AS (SELECT *, {fixed} AS fix FROM {name} WHERE NOT regexp_matches(before, '[A-Za-z0-9_]$') AND NOT regexp_matches(after, '^[A-Za-z0-9_]'))"


R08 = f"""WITH {CHECKED}, {_confused(G.CONFUSIONS, 'confused-words', 'a')}, {_confused(G.LIKELY, 'likely-confusion', 'b')}
{sql_issue('confused-words', 'af', 'true', CASED.format(a='hit', b='fix'))} UNION ALL {sql_issue('likely-confusion', 'bf', 'true', CASED.format(a='hit', b='fix'))}"""

LEX = f"""lex AS (SELECT phrase, rule, coalesce(s, '') AS s, len(string_split(phrase, ' ')) AS n FROM {values(G.lexicon_rows(), 'phrase', 'rule', 's')}),
ws AS (SELECT doc_id, {sql_words('text')} AS words FROM ck), wt AS (SELECT doc_id, words, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM ws),
one AS (SELECT doc_id, rule, pos, 1 AS n, phrase, s FROM wt JOIN lex ON lex.phrase = wt.w AND n = 1),
m0 AS (SELECT doc_id, pos, n, phrase, rule, s FROM wt JOIN lex ON n > 1 AND split_part(phrase, ' ', 1) = w AND array_to_string(words[pos + 1 : pos + n], ' ') = phrase),
m1 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, phrase) = 1), m2 AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM m1),
hits AS (SELECT * FROM one UNION ALL SELECT doc_id, rule, pos, n, phrase, s FROM m2 WHERE e IS NULL OR pos >= e),
va AS (SELECT *, count(*) FILTER (rule = 'british') OVER (PARTITION BY doc_id) AS uk, count(*) FILTER (rule = 'american') OVER (PARTITION BY doc_id) AS us FROM hits WHERE rule IN ('british', 'american')),
lx AS (SELECT doc_id, rule, pos, n, phrase, s AS suggestion FROM hits WHERE rule NOT IN ('british', 'american') UNION ALL
SELECT doc_id, 'mixed-spelling-variety', pos, n, phrase, s FROM va WHERE uk > 0 AND us > 0 AND rule = CASE WHEN uk <= us THEN 'british' ELSE 'american' END)"""
SEN = f"ss AS (SELECT doc_id, {sql_simple_sentences('text')} AS ss FROM ck), sen AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM ss)"
R10 = f"""pv AS (SELECT doc_id, ix, regexp_matches(' ' || s || ' ', {quote(S.PASSIVE)}) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM sen), pw AS (SELECT *, count(*) FILTER (p) OVER (PARTITION BY doc_id) AS k FROM pv), pas AS (SELECT doc_id, ix FROM pw WHERE p AND n >= 5 AND k > 0.4 * n)"""
R15 = f"""ls AS (SELECT doc_id, ix, s, {sql_count('s', T.WORD)} AS words, list_filter(string_split(s, chr(10)), lambda x: trim(x) != '') AS lines FROM sen),
lo AS (SELECT doc_id, ix, words, CASE WHEN words > 60 THEN 'error' ELSE 'warning' END AS severity FROM ls WHERE words > 40 AND NOT (len(lines) >= 3 AND len(list_filter(lines, lambda x: {sql_count('x', T.WORD)} <= 12)) >= 0.6 * len(lines)))"""
R16 = rf"""{PARAS}, rs0 AS (SELECT doc_id, ix AS paragraph, {sql_simple_sentences('text')} AS ss FROM pa), rs1 AS (SELECT doc_id, paragraph, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS ix FROM rs0),
rs2 AS (SELECT *, lower(regexp_extract(s, '^([\p{{L}}'']+)', 1)) AS word FROM rs1), rs3 AS (SELECT *, ix - row_number() OVER (PARTITION BY doc_id, paragraph, word ORDER BY ix) AS isl FROM rs2),
rst AS (SELECT doc_id, paragraph, ix, word FROM rs3 WHERE true QUALIFY word != '' AND row_number() OVER (PARTITION BY doc_id, paragraph, word, isl ORDER BY ix) = 3)"""
R17 = rf"""ns AS (SELECT doc_id, ix, regexp_extract(s, '^([0-9]+(?:[.,][0-9]+)?)', 1) AS number FROM sen WHERE NOT regexp_matches(s, '^[0-9]+(?:[.,][0-9]+)?[0-9.]*\s*[.)]') AND {sql_count('s', T.WORD)} >= 5), num AS (SELECT * FROM ns WHERE number != '')"""
R19 = rf"""{TOK}, ac AS (SELECT doc_id, regexp_replace(raw, 's$', '') AS acronym, "end" - length(raw) AS st FROM tk WHERE regexp_full_match(raw, '[A-Z]{{2,6}}s?')),
ag AS (SELECT doc_id, acronym, count(*) AS uses, min(st) AS first FROM ac WHERE NOT regexp_full_match(acronym, '[IVXLCDM]+') AND acronym NOT IN ({', '.join(quote(a) for a in ACRONYMS)}) GROUP BY ALL),
{sql_found('df', r'[(]\s*[A-Z]{2,6}s?\s*[)]')}, dg AS (SELECT doc_id, regexp_replace(regexp_extract(hit, '([A-Z]{{2,6}}s?)', 1), 's$', '') AS acronym, min("start") AS defined FROM df GROUP BY ALL),
acr AS (SELECT doc_id, CASE WHEN defined IS NULL AND uses >= 2 THEN 'undefined-acronym' WHEN defined > first THEN 'acronym-before-definition' END AS rule, acronym, uses FROM ag LEFT JOIN dg USING (doc_id, acronym))"""


def _of(f):
    return lambda spark, sf_dir: f(G.checked(texts(spark, sf_dir)))


def r21(spark, sf_dir):
    return G.all_counts(texts(spark, sf_dir)).select("doc_id", "rule", "severity", "n")


SEVERITY = "CASE " + " ".join(f"WHEN rule = '{k}' THEN '{s}'" for k, (_, s) in G.RULES.items()) + " END"


def _body(sql: str) -> str:
    """A rule's SELECT with its own CTEs, as a subquery."""
    return f"(SELECT doc_id, rule, severity FROM ({sql}))"


R21 = f"""WITH {CHECKED}, {SEN}, {LEX}, {R10}, {R15}, {R16}, {R17}, {R19},
i AS ({' UNION ALL '.join(_body(s) for s in (R01, R02, R05, R06, R07, R08))}),
o AS (SELECT doc_id, rule FROM lx UNION ALL SELECT doc_id, 'passive-voice' FROM pas UNION ALL SELECT doc_id, 'repeated-sentence-start' FROM rst UNION ALL SELECT doc_id, 'number-at-start' FROM num UNION ALL SELECT doc_id, rule FROM acr WHERE rule IS NOT NULL),
u AS (SELECT * FROM i UNION ALL SELECT doc_id, rule, {SEVERITY} FROM o UNION ALL SELECT doc_id, 'long-sentence', severity FROM lo)"""


def a16(spark, sf_dir):
    d = texts(spark, sf_dir)
    return G.summary(G.all_counts(d).select("doc_id", "severity", "n"), d.select("doc_id", T.word_count(F.col("text")).alias("words")))


A16 = f"""{R21}, n AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i FROM u GROUP BY doc_id),
g AS (SELECT t.doc_id, greatest({sql_count('text', T.WORD)}, 100) / 1000 AS k, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(i, 0) AS i FROM texts t LEFT JOIN n USING (doc_id))
SELECT doc_id, e + w + i AS total, e AS errors, w AS warnings, i AS infos, floor(round((e + w + i) / k, 9) * 10 + 0.5) / 10 AS per_1000, floor(round(least(100, greatest(0, 100 - (e * 5 + w * 2 + i * 0.4::DOUBLE) / k * 0.6::DOUBLE)), 9) + 0.5)::INT AS score FROM g"""

OWN = ((1, "a-an", "grammar", 0, 2), (1, "a-an", "grammar", 0, 2), (1, "long-sentence", "clarity", 10, 90), (2, "spelling", "spelling", 5, 9))
OTHERS = ((1, "LT1", "grammar", 1, 4), (1, "LT2", "style", 20, 30), (1, "LT3", "spelling", 95, 99), (2, "LT4", "punctuation", 9, 10), (2, "LT4", "punctuation", 9, 10))
FIXES = ((1, 0, 1, "An"), (1, 0, 3, "lost"), (1, 8, 13, "fruit"), (2, 4, 4, "new "), (3, 2, 5, ""))
FIXED_TEXTS = ((1, "A apple tastes good."), (2, "The day"), (3, "abcdefg"), (4, "untouched"))


#: Events as findings of two checkers in a document of 200 of them, half of the time in places of their own.
OWN_FROM = "SELECT CAST(floor(event_id / 200) AS BIGINT) + 100, 'rule' || CAST(event_id % 5 AS STRING), CASE event_id % 3 WHEN 0 THEN 'grammar' WHEN 1 THEN 'clarity' ELSE 'spelling' END, event_id % 200 * 10, event_id % 200 * 10 + event_id % 13 + 1 FROM {events} WHERE event_id % 2 = 0"
OTHERS_FROM = "SELECT CAST(floor(event_id / 200) AS BIGINT) + 100, 'LT' || CAST(event_id % 4 AS STRING), CASE event_id % 4 WHEN 0 THEN 'grammar' WHEN 1 THEN 'style' WHEN 2 THEN 'spelling' ELSE 'punctuation' END, event_id % 200 * 10 + 5, event_id % 200 * 10 + 9 FROM {events} WHERE event_id % 3 = 0"
#: Two fixes for each document, which may overlap.
FIXES_FROM = "SELECT doc_id + 100, n_chars % 20, n_chars % 20 + doc_id % 6, 'new' FROM {documents} WHERE text IS NOT NULL UNION ALL SELECT doc_id + 100, n_chars % 20 + 4, n_chars % 20 + 9, '' FROM {documents} WHERE text IS NOT NULL"
FIXED_FROM = "SELECT doc_id + 100, text || ' and a few words more at the end of it' FROM {documents} WHERE text IS NOT NULL"


def j17(spark, sf_dir):
    kind = "doc_id long, rule string, category string, start long, end long"
    return G.merge_issues(given(spark, sf_dir, OWN, kind, OWN_FROM), given(spark, sf_dir, OTHERS, kind, OTHERS_FROM))


COLS = ("doc_id", "rule", "category", '"start"', '"end"')
J17 = f"""WITH m AS (SELECT DISTINCT * FROM {given_sql(OWN, OWN_FROM, *COLS)}), o AS (SELECT DISTINCT * FROM {given_sql(OTHERS, OTHERS_FROM, *COLS)})
SELECT * FROM m UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = o.doc_id AND o."start" < m."end" AND m."start" < o."end" AND o.category IN ('grammar', 'spelling', 'punctuation'))"""


def r22(spark, sf_dir):
    return G.apply_fixes(given(spark, sf_dir, FIXED_TEXTS, "doc_id long, text string", FIXED_FROM), given(spark, sf_dir, FIXES, "doc_id long, start long, end long, suggestion string", FIXES_FROM))


R22 = f"""WITH RECURSIVE t AS (SELECT * FROM {given_sql(FIXED_TEXTS, FIXED_FROM, 'doc_id', 'text')}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, x) AS i FROM {given_sql(FIXES, FIXES_FROM, 'doc_id', 's', 'e', 'x')}),
g(doc_id, text, out, at_, n, i) AS (SELECT doc_id, text, '', 0, 0, 1 FROM t UNION ALL SELECT g.doc_id, g.text, CASE WHEN f.s < at_ THEN out ELSE out || substr(text, at_ + 1, f.s - at_) || f.x END, CASE WHEN f.s < at_ THEN at_ ELSE f.e END, CASE WHEN f.s < at_ THEN n ELSE n + 1 END, g.i + 1 FROM g JOIN f ON f.doc_id = g.doc_id AND f.i = g.i)
SELECT doc_id, out || substr(text, at_ + 1) AS text, n AS applied FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1"""

QUERIES = {
    "r01_repeated_words": _issues(G.repeated_words), "r02_r04_spacing": _issues(G.spacing), "r05_unbalanced": _issues(G.unbalanced), "r06_sentence_capitals": _issues(G.sentence_capitals), "r07_articles": _issues(G.articles), "r08_r09_confusions": _issues(G.confusions),
    "r11_r20_lexicon": _of(G.lexicon_issues), "r10_passive": _of(G.passives), "r15_long_sentences": _of(G.long_sentences), "r16_repeated_starts": _of(G.repeated_starts), "r17_number_starts": _of(G.number_starts), "r19_acronyms": _of(G.acronyms), "r21_all_counts": r21, "a16_grammar_summary": a16,
    "j17_merge_issues": j17, "r22_apply_fixes": r22,
}
ORACLES = {
    "r01_repeated_words": R01, "r02_r04_spacing": R02, "r05_unbalanced": R05, "r06_sentence_capitals": R06, "r07_articles": R07, "r08_r09_confusions": R08, "r11_r20_lexicon": f"WITH {CHECKED}, {LEX} SELECT * FROM lx", "r10_passive": f"WITH {CHECKED}, {SEN}, {R10} SELECT * FROM pas",
    "r15_long_sentences": f"WITH {CHECKED}, {SEN}, {R15} SELECT * FROM lo", "r16_repeated_starts": f"WITH {CHECKED}, {R16} SELECT * FROM rst", "r17_number_starts": f"WITH {CHECKED}, {SEN}, {R17} SELECT * FROM num", "r19_acronyms": f"WITH {CHECKED}, {R19} SELECT * FROM acr WHERE rule IS NOT NULL",
    "r21_all_counts": f"{R21} SELECT doc_id, rule, severity, count(*) AS n FROM u GROUP BY ALL", "a16_grammar_summary": A16, "j17_merge_issues": J17, "r22_apply_fixes": R22,
}
