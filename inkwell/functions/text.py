"""Text functions as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.lexicons import LOOKALIKES, STOPWORDS, SYNONYMS

#: Zero-width characters and the soft hyphen: they may stand inside a word.
INVISIBLE = "­​-‍⁠﻿"
#: A word: letters and digits of any script, inner apostrophes and hyphens, invisible characters inside.
WORD = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{INVISIBLE}]*(?:['’\-][\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{INVISIBLE}]*)*"
#: A word, or one mark of punctuation.
FEATURE_TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)?|[.,;:!?()\"“”'‘’\-–—]"


#: Compatibility forms that stand for other letters: ligatures, full-width letters and digits, raised and lowered digits.
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"))
WIDE = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))) + "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz01234567890123456789"


def _ranges(letters: str, gap: int = 32) -> str:
    """Ranges for a pattern that hold all letters and whatever lies between near ones."""
    out: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


#: Letters that may need folding, as few ranges: a class of many single letters takes a test for each of them at every letter.
RARE = f"[{_ranges(''.join(a for a, _ in LOOKALIKES) + ''.join(a for a, _ in LIGATURES) + WIDE)}{INVISIBLE}]"


def re2(pattern: str) -> str:
    """pattern with the meaning that it has in SQL, for Java: `\\s` without the vertical tab, `$` only at the very end."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        if c in ("\\s", "\\S"):
            c = {"\\s": " \\t\\n\\f\\r", "\\S": "\\S\\x0b"}[c] if inside else "[^ \\t\\n\\f\\r]" if c == "\\S" else "[ \\t\\n\\f\\r]"
        elif c == "$" and not inside:
            c = "\\z"
        inside = c[0] == "[" and len(c) == 1 or inside and c != "]"
        out += c
    return out


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable holds it, where an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def unconfuse(word: Column) -> Column:
    """Look-alike letters of other alphabets become Latin where the word has Latin letters or has nothing but look-alikes."""
    odd, plain = "".join(a for a, _ in LOOKALIKES), "".join(b for _, b in LOOKALIKES)
    only = F.regexp_replace(word, rf"[{odd}]|[^\p{{L}}]", "") == ""
    return F.when(word.rlike(f"[{odd}]") & (only | word.rlike("[A-Za-z]")), F.translate(word, odd, plain)).otherwise(word)


def compatible(word: Column) -> Column:
    """Ligatures, full-width forms and raised or lowered digits as plain letters and digits."""
    return reduce(lambda w, p: F.replace(w, F.lit(p[0]), F.lit(p[1])), LIGATURES, F.translate(word, WIDE, NARROW))


def normal(raw: Column) -> Column:
    """Lower-cased, invisible characters dropped, compatibility forms and look-alikes mapped, apostrophes unified."""
    same = lambda word: F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    odd = same(let(compatible(F.regexp_replace(raw, f"[{INVISIBLE}]", "")), unconfuse))
    return F.when(F.octet_length(raw) == F.length(raw), F.lower(raw)).when(~raw.rlike(RARE), same(raw)).otherwise(odd)


def raw_words(text: Column) -> Column:
    return matches(text, WORD)


def words(text: Column) -> Column:
    return F.transform(raw_words(text), normal)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def is_stopword(word: Column) -> Column:
    return word.isin(list(STOPWORDS))


def syllables(word: Column) -> Column:
    """Rough English syllables: words of up to three letters have one, silent endings don't count."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    bare = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+"))))


def stem(word: Column) -> Column:
    """Cheap suffix stripping: `studies`, `studied` and `study` meet."""
    cut = F.regexp_replace(F.regexp_replace(word, "ies$", "y"), "(?:ing|edly|ed|es|s)$", "")
    return F.when(F.length(word) <= 3, word).otherwise(F.regexp_replace(cut, r"(.)\1$", "$1"))


def concept_heads() -> dict[str, str]:
    """Stem of each synonym's inflections -> stem of its group's first word; the first group that has a stem keeps it."""
    import re

    def cut(w: str) -> str:
        if len(w) <= 3:
            return w
        return re.sub(r"(.)\1$", r"\1", re.sub("(?:ing|edly|ed|es|s)$", "", re.sub("ies$", "y", w)))

    heads: dict[str, str] = {}
    for group in SYNONYMS:
        members = group.split()
        for w in members:
            base = w.removesuffix("e")
            forms = [w, w + "s", w + "es", base + "ed", base + "ing", w + "d"]
            if w.endswith("y"):
                forms += [w[:-1] + "ies", w[:-1] + "ied"]
            for f in forms:
                heads.setdefault(cut(f), cut(members[0]))
    return heads


def concepts(text: Column) -> Column:
    """Distinct stems of content words, synonyms folded."""
    heads = F.create_map(*[F.lit(x) for kv in concept_heads().items() for x in kv])
    content = F.filter(words(text), lambda w: (F.length(w) >= 3) & ~is_stopword(w) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(content, lambda w: F.coalesce(F.try_element_at(heads, stem(w)), stem(w))))


#: Latin letters with marks and the letters they are built on.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normal_title(title: Column) -> Column:
    """Lower-case, without marks, tags and punctuation, single blanks."""
    t = F.lower(F.regexp_replace(F.translate(title, MARKED, BARE), "[̀-ͯ]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def title_tokens(title: Column) -> Column:
    return F.filter(F.split(normal_title(title), " "), lambda t: t != "")


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice over token multisets."""
    each = F.transform(F.array_distinct(a), lambda t: F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.aggregate(each, F.lit(0), lambda s, x: s + x) / (F.size(a) + F.size(b)))


def title_similarity(a: Column, b: Column) -> Column:
    """Dice of titles, at least 0.9 where 95 % of the shorter one's four or more tokens are in the longer one."""
    ta, tb = title_tokens(a), title_tokens(b)
    short = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb)
    long = F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    inside = F.size(F.filter(short, lambda t: F.array_contains(long, t))) / F.size(short)
    return F.when((F.size(short) >= 4) & (inside >= 0.95), F.greatest(dice(ta, tb), F.lit(0.9))).otherwise(dice(ta, tb))


def fnv18(s: Column) -> Column:
    """FNV-1a over code points, its last 18 bits."""
    codes = F.when(F.length(s) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("long")))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))
    return h.bitwiseAND(F.lit(262143))


def feature_tokens(text: Column) -> Column:
    return F.transform(matches(F.replace(F.lower(text), F.lit("’"), F.lit("'")), FEATURE_TOKEN), lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("<num>")).otherwise(t))


def simple_sentences(text: Column) -> Column:
    """Sentences by end marks and closers before white space; no look-back for abbreviations (see operators.sentences for that)."""
    cut = F.split(F.regexp_replace(text, re2(r"([.!?]+[\"')\]]*)\s+"), "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, re2(r"^\s+|\s+$"), "")), lambda s: s != "")


def ramp(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear from (x0, y0) to (x1, y1), flat outside."""
    if x1 == x0:
        return F.lit(float(y0))
    return y0 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - x0) / (x1 - x0))) * (y1 - y0)


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def match_case(source: Column, target: Column) -> Column:
    """target in the case of source: ALL CAPS, Capital or as it is."""
    first = F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, F.lit(2), F.length(target)))
    return F.when((F.length(source) > 1) & (source == F.upper(source)) & (source != F.lower(source)), F.upper(target)).when(F.substring(source, 1, 1).rlike("^[A-Z]"), first).otherwise(target)


def expand_numbers(spec: Column) -> Column:
    """'1-4, 7' -> [1, 2, 3, 4, 7]; ranges of more than 60 numbers give their ends."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(spec, "[–—]", "-"), r"[,;]"), lambda x: F.trim(x)), lambda p: p.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$"))
    lo = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    hi = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*([0-9]+)$", 1).try_cast("int"), lo(p))
    span = lambda p: F.when((hi(p) >= lo(p)) & (hi(p) - lo(p) <= 60), F.sequence(lo(p), F.greatest(hi(p), lo(p)))).otherwise(F.array(lo(p), hi(p)))
    return F.array_distinct(F.flatten(F.transform(parts, span)))


def any_of(text: Column, pairs: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the patterns that text has."""
    return reduce(lambda a, b: a + b, [F.when(text.rlike(p), F.lit(float(w))).otherwise(F.lit(0.0)) for p, w in pairs], F.lit(0.0))
