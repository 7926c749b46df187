"""Rewriting: rule-based plain wording, checks of a rewrite against its original, style problems, writing quality, word diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import preparing as P
from inkwell.operators import statistics as S

EDGE = r"[^A-Za-z0-9_]"
#: Inflated words, as patterns.
INFLATED = (
    "utili[sz](?:e|es|ed|ing|ation)", "leverag(?:e|es|ed|ing)", "facilitat(?:e|es|ed|ing)", "delv(?:e|es|ed|ing)", "(?:pivotal|paramount)", "underscor(?:e|es|ed|ing)", "showcas(?:e|es|ed|ing)", "commenc(?:e|es|ed|ing)", "endeavou?rs?", "(?:myriad|plethora)",
    "tapestry", "realm", "holistic(?:ally)?", "seamless(?:ly)?", "multifaceted", "(?:ever-evolving|rapidly evolving|ever-changing) landscape", "testament to", "it is (?:important|worth|crucial) (?:to note|noting)(?: that)?", "shed(?:s|ding)? light on",
    "pav(?:e|es|ed|ing) the way", "navigat(?:e|es|ed|ing) the complexities", "in the realm of", "aforementioned", "notwithstanding", "heretofore", "wherein", "bolster(?:s|ed|ing)?", "streamlin(?:e|es|ed|ing)", "ascertain(?:s|ed|ing)?", "harness(?:es|ed|ing)?",
    "foster(?:s|ed|ing)?", "cutting-edge", "game-chang(?:er|ing)",
)
#: Wordy phrases whose plain form always fits.
PLAIN = (
    ("in order to", "to"), ("due to the fact that", "because"), ("owing to the fact that", "because"), ("in spite of the fact that", "although"), ("despite the fact that", "although"), ("at this point in time", "now"), ("at the present time", "now"),
    ("in the event that", "if"), ("prior to", "before"), ("subsequent to", "after"), ("a (?:large|great) number of", "many"), ("the (?:vast )?majority of", "most"), ("a small number of", "a few"), ("is able to", "can"), ("are able to", "can"),
    ("has the ability to", "can"), ("have the ability to", "can"), ("for the purpose of", "for"), ("with the exception of", "except"), ("in close proximity to", "near"),
)
#: Phrases that pad prose.
STOCK = (
    "plays? an? (?:crucial|pivotal|vital|key|important|significant|essential) role", "in (?:today's|the modern|the current) (?:world|era|age|landscape)", "in recent years", "a wide (?:range|variety|array) of", "it (?:is|should be) (?:noted|emphasi[sz]ed|highlighted) that",
    "(?:offers?|provides?) (?:valuable|meaningful|important) insights?", "contributes? (?:significantly )?to (?:the|a) (?:broader|better|deeper) understanding", "(?:holds|hold) (?:great|significant|immense|tremendous) (?:promise|potential)", "in conclusion",
    "future research (?:should|could|may) (?:explore|investigate|focus)",
)
#: Patterns that decide scores and must match for right results: openers, the passive, concrete detail.
OPENERS = r"^(?:Moreover|Furthermore|Additionally|In addition|Notably|Importantly|Overall|Ultimately|Consequently|Thus|Hence),"
REWRITE_OPENERS = r"^(?:Moreover|Furthermore|Additionally|In addition|Notably|Importantly|Overall|In conclusion|Ultimately|Consequently),"
PASSIVE = r"(?i)(?:is|are|was|were|be|been|being)\s+(?:[A-Za-z0-9_]+ly\s+)?[A-Za-z0-9_]+(?:ed|en|wn|lt|ght)"
#: Fixed value: numbers with units, citations with years, numeric citations, names inside sentences.
SPECIFIC = r"[0-9][0-9.,]*\s*(?:%|[a-zµ°]{1,4})?|\([A-Za-z0-9_][^()]{0,40}[0-9]{4}[a-z]?\)|\[[0-9]+(?:[,–-]\s*[0-9]+)*\]|[a-z,;] (?:[A-Z][a-z]+(?:-[A-Z][a-z]+)?|[A-Z]{2,}[a-z]?s?)"
#: Accepted length of a rewrite, as a share of the original's words, by strength.
LENGTHS = {"light": (0.75, 1.25), "balanced": (0.65, 1.35), "strong": (0.55, 1.45)}


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How often text has any of the patterns between edges of words: one alternation, edges doubled so that neighbours count."""
    t = F.concat(F.lit(" "), F.regexp_replace(text, f"({EDGE})", "$1$1"), F.lit(" "))
    return F.regexp_count(t, F.lit(f"(?i){EDGE}(?:" + "|".join(p.replace(" ", "  ") for p in patterns) + f"){EDGE}"))


def _needle(pattern: str) -> str:
    """The longest literal stretch of a phrase's pattern."""
    return max(re.split(r"\(\?:[^)]*\)\??", pattern), key=len)


def _plainer(text: Column, phrase: str, plain: str) -> Column:
    rest = phrase[1:].replace("s", "[s\u017f]").replace("k", "[k\u212a]")
    has = F.contains(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit(_needle(phrase)))
    out = text
    for a, b in ((phrase[0], plain), (phrase[0].upper(), plain[:1].upper() + plain[1:])):
        out = F.regexp_replace(out, rf"(^|{EDGE}){a}(?i:{rest})(\z|{EDGE})", f"$1{b}$2")
    return F.when(has, out).otherwise(text)


def plain_wording(text: Column) -> Column:
    """Wordy phrases become plain ones, capitals kept, double blanks single.

    A text without a phrase's letters is not searched for it: what the steps before made of a text is tested each time."""
    step = lambda p, plain: lambda t: _plainer(t, p, plain)
    for p, plain in PLAIN:
        text = T.let(text, step(p, plain))
    return F.regexp_replace(text, " {2,}", " ")


def problems(masked: Column, output: Column, strength: str) -> Column:
    """array<string>: what is wrong with a rewrite of a text with placeholders."""
    ids = lambda c: F.regexp_extract_all(c, F.lit(P.PLACEHOLDER), F.lit(1))
    want, got = ids(masked), ids(output)
    bare = lambda c: P.numbers(F.regexp_replace(c, P.PLACEHOLDER, " "))
    n, m = T.word_count(masked), T.word_count(output)
    lo, hi = LENGTHS[strength]
    checks = [
        ("placeholders missing", F.size(F.array_except(want, got)) > 0), ("placeholders invented or repeated", (F.size(F.array_except(got, want)) > 0) | (F.size(got) > F.size(F.array_distinct(got)))),
        ("numbers dropped", F.size(P.multiset_less(bare(masked), bare(output))) > 0), ("numbers added", F.size(P.multiset_less(bare(output), bare(masked))) > 0),
        ("length", (n >= 12) & ((m / n < lo) | (m / n > hi))), ("markdown", output.rlike(r"(?m)\*\*|__|^#+\s")), ("empty", F.trim(output) == ""),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))


def style_issues(original: Column, output: Column) -> Column:
    """array<string>: inflated words, stock openers, flat rhythm, added dashes, 'not only ... but also'."""
    parts = lambda c: F.filter(T.simple_sentences(c), lambda s: T.word_count(s) >= 3)
    opened = lambda c: F.size(F.filter(parts(c), lambda s: s.rlike(REWRITE_OPENERS)))
    lengths = F.transform(parts(output), T.word_count)
    dashes = lambda c: F.regexp_count(c, F.lit(r"—|\s–\s"))
    checks = [
        ("inflated words", hits(output, INFLATED) > 0), ("stock openers", (opened(output) > 0) & (opened(output) >= opened(original))), ("flat rhythm", (F.size(lengths) >= 4) & (S.deviation(lengths, True) < 0.22 * S.mean(lengths))),
        ("dashes", dashes(output) > dashes(original)), ("not only", output.rlike(r"(?i)not only[^.]*but also") & ~original.rlike("(?i)not only")),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))


def specificity(text: Column) -> Column:
    """Concrete details in 100 words."""
    n = T.word_count(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(SPECIFIC)) / n * 100).otherwise(0.0)


def writing_quality(docs: DataFrame) -> DataFrame:
    """doc_id, plain, easy, variety, active, specific, score (0 to 100)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"), T.simple_sentences(text).alias("s"), T.matches(text, r"\p{L}+").alias("letters"))
    d = d.withColumn("l", F.filter(F.transform("s", T.word_count), lambda n: n >= 3)).withColumn("words", T.word_count(F.col("t"))).withColumn("syl", F.transform("letters", T.syllables))
    n = F.greatest(F.size("l"), F.lit(1))
    padding = hits(F.col("t"), INFLATED) + hits(F.col("t"), tuple(p for p, _ in PLAIN)) + hits(F.col("t"), STOCK) + F.size(F.filter("s", lambda s: s.rlike(OPENERS)))
    m = S.mean(F.col("l"))
    cv = F.when(m > 0, S.deviation(F.col("l"), True) / m).otherwise(0.0)
    long = F.size(F.filter("l", lambda x: x > 35)) / n
    w = F.greatest("words", F.lit(1))
    long_words = F.when(F.col("words") > 0, F.size(F.filter("syl", lambda s: s >= 4)) / w).otherwise(0.0)
    syl = F.aggregate("syl", F.lit(0), lambda a, x: a + x) / w
    passive = F.regexp_count(F.concat(F.lit(" "), "t", F.lit(" ")), F.lit(f"(?i){EDGE}{PASSIVE[4:]}{EDGE}")) / n
    zero = lambda c: F.greatest(F.lit(0.0), c)
    clamp = lambda c: F.floor(F.round(F.least(F.lit(100.0), zero(c)), 9) + 0.5).cast("int")
    parts = {
        "plain": clamp(100 - F.when(F.col("words") > 0, padding / w * 100).otherwise(0.0) * 28), "easy": clamp(100 - zero(m - 22) * 4 - long * 120 - zero(long_words - 0.12) * 300 - zero(syl - 1.75) * 80),
        "variety": F.when(F.size("l") < 3, 100).otherwise(clamp(cv / 0.45 * 100)), "active": clamp(100 - zero(passive - 0.25) * 140), "specific": clamp(specificity(F.col("t")) / 4 * 100),
    }
    d = d.select("doc_id", *[c.alias(k) for k, c in parts.items()])
    return d.withColumn("score", clamp(F.col("plain") * 0.3 + F.col("easy") * 0.2 + F.col("variety") * 0.15 + F.col("active") * 0.15 + F.col("specific") * 0.2))


def clean_reply(reply: Column) -> Column:
    """A reply without code fences, prefaces and wrapping quotes."""
    out = F.regexp_replace(reply, r"^\s+|\s+$", "")
    out = F.regexp_replace(out, r"(?s)^```[a-z]*\n(.*?)\n?```$", "$1")
    out = F.regexp_replace(out, r"(?i)^(?:sure[,!.]?\s*)?(?:here(?:'s| is) (?:the |a |your )?(?:rewritten|revised|paraphrased|edited|simplified|expanded|condensed|shortened)[^\n:]*:)\s*", "")
    out = F.regexp_replace(out, r"(?i)^(?:rewritten|revised) (?:passage|text|version):\s*", "")
    return F.trim(F.regexp_replace(out, r"(?s)^[\"“]([^\"“”]*)[\"”]$", "$1"))


def common_words(p: list[str], q: list[str]) -> int:
    """Words of a longest common subsequence: a bit for each word of q, all rows of the table at once in whole numbers.

    Time is len(p) * len(q) / 64, memory that of the words, so long texts need no other rule."""
    at: dict[str, int] = {}
    for k, w in enumerate(q):
        at[w] = at.get(w, 0) | 1 << k
    whole = (1 << len(q)) - 1
    row = whole
    for w in p:
        met = row & at.get(w, 0)
        row = (row + met | row - met) & whole
    return len(q) - row.bit_count()


def diff_share(pairs: DataFrame) -> DataFrame:
    """id, kept, changed_share of pairs (id, before, after; null: empty): words outside a longest common subsequence, by both sides'
    words, exact at every length."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for i, x, y in zip(b.id, b.before, b.after, strict=True):
                p, q = (x or "").split(), (y or "").split()
                n, first, last = min(len(p), len(q)), 0, 0
                while first < n and p[first] == q[first]:
                    first += 1
                while last < n - first and p[-1 - last] == q[-1 - last]:
                    last += 1
                kept = first + last + common_words(p[first : len(p) - last], q[first : len(q) - last])
                total = len(p) + len(q)
                rows.append((i, kept, round((total - 2 * kept) / max(total, 1), 6)))
            yield pd.DataFrame(rows, columns=["id", "kept", "changed_share"])

    return pairs.select("id", "before", "after").mapInPandas(run, "id long, kept long, changed_share double")
