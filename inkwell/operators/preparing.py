"""Document preparation: protected spans, masks, quotations, reference lists, titles, windows and packed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

_NAME = r"[A-Z][\p{L}'’\-]+"
#: What is protected from analysis, by kind, in order of precedence where matches start together.
PROTECTED = (
    ("math", r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|\$[^$\n]{1,200}\$"),
    ("latex", r"\\(?:cite[a-z]*|ref|eqref|autoref|cref|label|footnote)\*?(?:\[[^\]]*\])*\{[^}]*\}"),
    ("url", r"https?://[^\s)>\]}\"']+"),
    ("doi", r"10\.[0-9]{4,9}/[^\s\"<>)\]]+"),
    ("cite", r"\[[0-9]+(?:\s*[,;–\-]\s*[0-9]+)*\]|\((?:(?:see|e\.g\.,?|cf\.|also|but see)\s+)?" + _NAME + r"[^()]{0,200}?[^0-9A-Za-z_()](?:19|20)[0-9]{2}[a-z]?(?:[;,][^()]*)?\)|" + _NAME + r"(?:\s+(?:and|&)\s+" + _NAME + r"|\s+et\s+al\.?)?\s*\((?:19|20)[0-9]{2}[a-z]?(?:,\s*p+\.\s*[0-9]+(?:\s*[–-]\s*[0-9]+)?)?\)"),
    ("ref", r"(?:Fig(?:ure)?s?\.?|Tables?|Eq(?:uation)?s?\.?|Sections?|Sec\.|Appendix|Algorithm|Theorem|Lemma|Proposition)\s+[A-Z]?[0-9]+(?:\.[0-9]+)*[a-z]?(?:\s*[–-]\s*[0-9]+)?"),
)
ANY_PROTECTED = "|".join(f"(?:{p})" for _, p in PROTECTED)
MASK = "\u0001"
NUMBER = r"(?:^|[^\p{L}0-9])([-−+]?[0-9]+(?:[.,][0-9]+)*(?:[eE][-+]?[0-9]+)?)"
PLACEHOLDER = r"\{\{\s*P([0-9]+)\s*\}\}"
QUOTED = r'["“][^"“”\n]{1,1000}?["”]'
REFERENCE_HEADING = r"(?i)(?:references|bibliography|works cited|literature cited|reference list)"


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """(stretches between matches, matches): one more of the former."""
    return F.split(text, pattern, -1), T.matches(text, pattern)


def replaced(text: Column, pattern: str, by) -> Column:
    """text with each match m replaced by by(m, its place from 0)."""
    gaps, hits = pieces(text, pattern)
    new = F.transform(hits, lambda m, i: by(m, i))
    return F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def masked(text: Column) -> Column:
    """Protected stretches become MASK characters; the length stays, so offsets do too.

    Where patterns start at one place the first in PROTECTED wins, not the longest."""
    return replaced(text, T.re2(ANY_PROTECTED), lambda m, _: F.repeat(F.lit(MASK), F.length(m)))


def with_placeholders(text: Column) -> Column:
    return replaced(text, ANY_PROTECTED, lambda m, i: F.concat(F.lit("{{P"), (i + 1).cast("string"), F.lit("}}")))


def restored(output: Column, spans: Column) -> Column:
    """struct<text, missing, duplicated, unknown>: placeholders in output replaced by spans (array, ids from 1)."""
    ids = F.transform(F.regexp_extract_all(output, F.lit(PLACEHOLDER), F.lit(1)), lambda i: i.cast("int"))
    issued = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    text = replaced(output, PLACEHOLDER, lambda m, _: F.coalesce(F.try_element_at(spans, F.regexp_extract(m, r"([0-9]+)", 1).cast("int")), F.lit("")))
    known = F.filter(ids, lambda i: F.array_contains(issued, i))
    twice = F.array_distinct(F.filter(known, lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1))
    return F.struct(text.alias("text"), F.array_except(issued, ids).alias("missing"), twice.alias("duplicated"), F.array_except(ids, issued).alias("unknown"))


def numbers(text: Column) -> Column:
    """Numbers in order, with ASCII minus signs."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda n: F.replace(n, F.lit("−"), F.lit("-")))


def multiset_less(a: Column, b: Column) -> Column:
    """What a has more often than b, sorted, as often as it is more."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    extra = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.array_repeat(x, F.greatest(count(a, x) - count(b, x), F.lit(0))))
    return F.flatten(extra)


def blank_quotes(text: Column, least: int = 40) -> Column:
    """Quotations of `least` characters or more become as many blanks."""
    return replaced(text, QUOTED, lambda q, _: F.when(F.length(q) >= least, F.repeat(F.lit(" "), F.length(q))).otherwise(q))


def body(text: Column) -> Column:
    """text up to the last reference heading (a line of its own) that stands in its last 70 %."""
    head = F.regexp_extract(text, r"(?s)^(.*\n)[ \t]*" + REFERENCE_HEADING + r"[ \t]*:?[ \t]*\n", 1)
    return F.when((head != "") & (F.length(head) >= 0.3 * F.length(text)), head).otherwise(text)


def title(text: Column) -> Column:
    """The first block on up to three lines, or else its first line, if it has 4 to 200 characters and doesn't end a sentence."""
    block = F.element_at(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n\s*\n"), 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    joined = F.when(F.size(lines) <= 3, F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")).otherwise(first)
    good = lambda t: (F.length(t) > 3) & (F.length(t) <= 200) & ~t.rlike("[.!?]$")
    return F.when(good(joined), joined).when(good(first), first)


def is_prose(text: Column) -> Column:
    """40 words or more, 60 % of them plain."""
    w = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    plain = F.filter(w, lambda t: t.rlike(r"^[(\"“]?[A-Za-z][a-z'’-]+[,.;:)\"”]*$"))
    return (F.size(w) >= 40) & (F.size(plain) >= 0.6 * F.size(w))


def windows(words: Column, size: int, step: int) -> Column:
    """array<struct<start,end>> of overlapping word windows; the last one reaches the end."""
    n = F.size(words)
    more = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    all_ = F.transform(F.sequence(F.lit(0), more), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
    return F.when(n > 0, all_).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def packed(sizes: Column, least: int, tail: int) -> Column:
    """array<struct<first,last,size>> (places from 1): neighbours joined until `least`; a rest under `tail` joins the one before."""
    kind = "array<struct<first:int,last:int,size:int>>"
    begin = F.struct(F.array().cast(kind).alias("done"), F.lit(1).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("open"))

    def step(s: Column, x: Column) -> Column:
        total, at = s["open"] + x, s["at"] + 1
        full = total >= least
        one = F.struct(s["first"].alias("first"), at.alias("last"), total.alias("size"))
        return F.struct(F.when(full, F.array_append(s["done"], one)).otherwise(s["done"]).alias("done"), F.when(full, at + 1).otherwise(s["first"]).alias("first"), at.alias("at"), F.when(full, 0).otherwise(total).alias("open"))

    def end(s: Column) -> Column:
        rest = F.struct(s["first"].alias("first"), s["at"].alias("last"), s["open"].alias("size"))
        last = F.try_element_at(s["done"], F.lit(-1))
        longer = F.struct(last["first"].alias("first"), s["at"].alias("last"), (last["size"] + s["open"]).alias("size"))
        joined = F.array_append(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))), longer)
        return F.when(s["open"] == 0, s["done"]).when((F.size(s["done"]) > 0) & (s["open"] < tail), joined).otherwise(F.array_append(s["done"], rest))

    return F.aggregate(sizes, begin, step, end)


def segments(docs: DataFrame, least: int = 150, tail: int = 80) -> DataFrame:
    """doc_id, ix, text, words: paragraphs joined to `least` words or more."""
    blocks = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    d = docs.select("doc_id", blocks.alias("ps"))
    d = d.withColumn("cut", packed(F.transform("ps", lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))), least, tail))
    return d.select("doc_id", "ps", F.posexplode("cut").alias("ix", "c")).select("doc_id", "ix", F.array_join(F.slice("ps", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), "\n\n").alias("text"), F.col("c.size").alias("words"))


def reflow(docs: DataFrame, longest: int = 250, target: int = 140) -> DataFrame:
    """doc_id, block, ix, text: blocks over `longest` words are cut into paragraphs of about `target` words at sentence ends."""
    d = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n")).alias("block", "t"))
    d = d.withColumn("ss", F.when(T.word_count(F.col("t")) <= longest, F.array("t")).otherwise(T.simple_sentences(F.col("t"))))
    d = d.withColumn("cut", packed(F.transform("ss", T.word_count), target, -(-target // 3)))
    d = d.withColumn("cut", F.when(F.size("ss") == 1, F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("last"), T.word_count(F.col("t")).cast("int").alias("size")))).otherwise(F.col("cut")))
    return d.select("doc_id", "block", "ss", F.posexplode("cut").alias("ix", "c")).select("doc_id", "block", "ix", F.array_join(F.slice("ss", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), " ").alias("text"))


#: Abbreviations that don't end a sentence.
ABBREVIATIONS = tuple(
    "e.g i.e fig figs eq eqs dr mr mrs ms prof vs no nos vol vols pp p ca cf approx sec secs ch ref refs st jr sr inc ltd co "
    "dept univ ed eds resp viz est avg max min etc al".split()
)


def exact_sentences(text: Column) -> Column:
    """Sentences with look-back: initials and abbreviations don't end one, nor does a mark before a lower-case word; 'etc.' and
    'al.' end one only before A-Z. Pieces of the simple split are joined again where the rule says so."""
    parts = T.simple_sentences(text)

    def open_(s: Column, nxt: Column) -> Column:
        last = F.lower(F.regexp_extract(s, r"([\p{L}.]*)\.[\"')\]]*$", 1))
        initial = s.rlike(r"(?:^|[\s(])[A-Z]\.$")
        lower = nxt.rlike(r"^[\"'(\[“]*[a-z]")
        maybe = last.isin("etc", "al") & nxt.rlike(r"^[\"'(\[“]*[A-Z]")
        return s.endswith(".") & (initial | lower | (last.isin(list(ABBREVIATIONS)) & ~maybe))

    start = F.array().cast("array<string>")
    join = lambda a, s: F.array_append(F.slice(a, 1, F.size(a) - 1), F.concat(F.element_at(a, -1), F.lit(" "), s))
    return F.aggregate(parts, start, lambda a, s: F.when(F.size(a) == 0, F.array(s)).when(open_(F.element_at(a, -1), s), join(a, s)).otherwise(F.array_append(a, s)))
