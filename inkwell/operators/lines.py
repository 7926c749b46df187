"""Text that a layout broke into lines: lines joined again, by the document's own mean line length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import let

#: Page numbers, headings on lines of their own.
PAGE = r"(?i)^(?:page\s+)?[0-9]{1,4}(?:\s*(?:of|/)\s*[0-9]{1,4})?$"
HEADING = r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?(?:references|bibliography|abstract|introduction|background|methods?|materials and methods|results|discussion|conclusions?|acknowledg(?:e)?ments)$"
SHORT = 0.7


def rejoined(raw: Column) -> Column:
    """raw without page numbers; broken words and lines are joined, blank lines, headings and short last lines end paragraphs.

    A first pass over all lines gives their mean length; the second is a fold that holds back one line until the next tells how
    the two are glued. What stands before a line counts page numbers, what it is glued to doesn't."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\r\n?", "\n"), "­", ""), r"[ \t]+", " ")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))

    def mean(every: Column) -> Column:
        return let(F.filter(every, lambda x: (x != "") & ~x.rlike(PAGE)), lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x)) / F.size(c)).otherwise(F.lit(0.0)))

    def state(parts: Column, held: Column, before: Column, blank: Column) -> Column:
        return F.struct(parts.alias("parts"), held.alias("held"), before.alias("before"), blank.alias("blank"))

    def put(a: Column, x: Column, length: Column) -> Column:
        last = a["before"].rlike("[.!?:][\"”)]?$") & (F.length(a["before"]) < length * SHORT) & x.rlike("^[A-Z0-9\\[“\"(]")
        ends = a["blank"] | last | x.rlike(HEADING) | a["before"].rlike(HEADING)
        broken = ~a["blank"] & a["held"].rlike("[a-z]-$") & x.rlike("^[a-z]")
        pushed = F.when(broken, F.substring(a["held"], F.lit(1), F.length(a["held"]) - 1)).when(ends, F.concat(a["held"], F.lit("\n\n"))).otherwise(F.concat(a["held"], F.lit(" ")))
        first = state(a["parts"], x, x, F.lit(False))
        more = state(F.array_append(a["parts"], pushed), x, x, F.lit(False))
        return F.when(x == "", state(a["parts"], a["held"], a["before"], F.lit(True))).when(x.rlike(PAGE), state(a["parts"], a["held"], x, a["blank"])).when(a["held"].isNull(), first).otherwise(more)

    begin = state(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(""), F.lit(False))
    joined = lambda every, n: F.aggregate(every, begin, lambda a, x: put(a, x, n), lambda a: F.concat(F.array_join(a["parts"], ""), F.coalesce(a["held"], F.lit(""))))
    return let(lines, lambda every: let(mean(every), lambda n: joined(every, n)))
