"""Queries on text integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import TORTURED
from inkwell.operators import integrity as I
from inkwell.plans.common import TEXTS, quote, sql_unconfuse, sql_words, texts, values

SPACED = "a" + "".join(f"{c}word" for c in "          ") + " end of it"
SOFT = " ".join("in­fra­struc­ture" for _ in range(5))


def _docs(spark, sf_dir):
    return texts(spark, sf_dir).unionByName(spark.createDataFrame([(-301, SPACED), (-302, SOFT)], "doc_id long, text string"))


def g01(spark, sf_dir):
    return I.tricks(_docs(spark, sf_dir))


ODD, ZW, DROP, SP = I.ODD, I.ZERO_WIDTH, I.DROPPED, I.ODD_SPACE
G01 = rf"""WITH {TEXTS}, d AS (SELECT doc_id, text AS t FROM texts UNION ALL SELECT * FROM {values([(-301, SPACED), (-302, SOFT)], 'doc_id', 'text')}),
w0 AS (SELECT doc_id, regexp_split_to_array(t, {quote(I.PART)}) AS gaps, regexp_extract_all(t, {quote(I.PART)}) AS ws, len(regexp_extract_all(t, '[A-Za-z]')) > 3 * len(regexp_extract_all(t, '[Ͱ-ϿЀ-ӿ]')) + 5 AS latin FROM d),
w1 AS (SELECT doc_id, latin, unnest(ws) AS word, unnest(gaps[1 : len(ws)]) AS gap, generate_subscripts(ws, 1) AS ix FROM w0), w2 AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY ix)::BIGINT AS e, regexp_replace(word, '[{DROP}]', '', 'g') AS seen FROM w1),
w AS (SELECT *, e - length(word) AS s, len(regexp_extract_all(seen, '[{ODD}]')) AS odd, len(regexp_extract_all(word, '[{ZW}]')) AS hid, len(regexp_extract_all(word, '\p{{L}}\x{{ad}}')) AS soft FROM w2),
f AS (SELECT doc_id, 'lookalike_letters' AS kind, s, e, odd AS c FROM w WHERE odd > 0 AND ({sql_unconfuse('seen')}) != seen AND CASE WHEN regexp_matches(seen, '[A-Za-z]') THEN len(regexp_extract_all(seen, '\p{{L}}')) >= 3 ELSE length(seen) >= 3 AND latin END
 UNION ALL SELECT doc_id, 'invisible_characters', s, e, hid FROM w WHERE hid > 0 AND regexp_matches(regexp_replace(word, '[{ZW}]', '', 'g'), '\p{{L}}')
 UNION ALL SELECT doc_id, 'invisible_characters', s, e, soft FROM w WHERE soft > 0 QUALIFY sum(soft) OVER (PARTITION BY doc_id) >= 10
 UNION ALL SELECT doc_id, 'unusual_spaces', p, p + 1, 1 FROM (SELECT doc_id, unnest(list_filter(range(length(t)), lambda i: regexp_matches(substr(t, i + 1, 1), '[{SP}]'))) AS p FROM d WHERE len(regexp_extract_all(t, '[{SP}]')) >= 8)),
n AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY doc_id, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 40 THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM n)
SELECT doc_id, kind, min(s) AS "start", max(e) AS "end", sum(c)::BIGINT AS count FROM i GROUP BY doc_id, kind, isl"""


def g05(spark, sf_dir):
    return I.tortured(texts(spark, sf_dir))


def _lexicon():
    rows = [(p.replace("-", " "), e) for p, e in TORTURED]
    return sorted(dict([(p + "s", e) for p, e in rows if not p.endswith("s")] + rows).items())


G05 = f"""WITH {TEXTS}, lex AS (SELECT phrase, value, len(string_split(phrase, ' ')) AS n FROM {values(_lexicon(), 'phrase', 'value')}), ws AS (SELECT doc_id, flatten(list_transform({sql_words('text')}, lambda w: string_split(w, '-'))) AS words FROM texts),
t AS (SELECT doc_id, words, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM ws), m AS (SELECT doc_id, pos, n, phrase, value FROM t JOIN lex ON split_part(phrase, ' ', 1) = w AND array_to_string(words[pos + 1 : pos + n], ' ') = phrase),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, phrase) = 1), e AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b) SELECT doc_id, pos, phrase, value AS expected FROM e WHERE e IS NULL OR pos >= e"""


def f09(spark, sf_dir):
    """Look-alike letters inside Latin words and invisible characters, by text."""
    t = F.coalesce("text", F.lit(""))
    words = T.matches(F.regexp_replace(t, f"[{DROP}]", ""), r"\p{L}+")
    odd = F.aggregate(F.transform(F.filter(words, lambda w: w.rlike("[A-Za-z]")), lambda w: F.regexp_count(w, F.lit(f"[{ODD}]"))), F.lit(0), lambda s, x: s + x)
    d = _docs(spark, sf_dir).select("doc_id", odd.alias("homoglyphs"), F.regexp_count(t, F.lit(f"[{DROP}]")).alias("invisible"))
    return d.where("homoglyphs + invisible > 0")


F09 = rf"""WITH {TEXTS}, d AS (SELECT doc_id, text AS t FROM texts UNION ALL SELECT * FROM {values([(-301, SPACED), (-302, SOFT)], 'doc_id', 'text')}),
c AS (SELECT doc_id, coalesce(list_sum(list_transform(list_filter(regexp_extract_all(regexp_replace(t, '[{DROP}]', '', 'g'), '\p{{L}}+'), lambda w: regexp_matches(w, '[A-Za-z]')), lambda w: len(regexp_extract_all(w, '[{ODD}]')))), 0)::BIGINT AS homoglyphs, len(regexp_extract_all(t, '[{DROP}]')) AS invisible FROM d) SELECT * FROM c WHERE homoglyphs + invisible > 0"""

QUERIES = {"g01_g03_tricks": g01, "g05_tortured_phrases": g05, "f09_evasion_counts": f09}
ORACLES = {"g01_g03_tricks": G01, "g05_tortured_phrases": G05, "f09_evasion_counts": F09}
