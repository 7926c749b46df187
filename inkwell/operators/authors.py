"""Author blocks of reference entries: three layouts of names compete, the one that explains most of the text wins.

A layout is a list of name patterns; a fold takes one name after the other from what is left of the block. It has as many
steps as the block has separators, and one more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import let

#: How names are written, and what parts them.
PARTICLE = r"(?:(?:van|von|de|der|den|di|da|del|della|la|le|bin|ibn|al|el|ter|ten|du|dos|das|st\.?)\s+)*"
CAPWORD = r"\p{Lu}[\p{L}'’\-]*\p{Ll}[\p{L}'’\-]*"
FAMILY = rf"{PARTICLE}{CAPWORD}(?:\s+{CAPWORD})?"
INITIAL = r"\p{Lu}(?:\.|(?!\p{L}))"
INITIALS = rf"(?:{INITIAL}(?:\s*-\s*{INITIAL})?\s*)+"
GIVEN = rf"{CAPWORD}(?:\s+(?:{CAPWORD}|\p{{Lu}}\.?))*"
SEPARATOR = r"\s*(?:,\s*(?:&|and)\s+|,\s*|;\s*|\s+&\s+|\s+and\s+)"
ORGANISATION = (
    r"(?i)\b(?:organi[sz]ation|association|institute|university|society|committee|council|department|agency|commission|foundation|ministry|bureau|center|centre|group|board|"
    r"academy|office|laboratory|consortium|network|union|service|company|corporation|inc|ltd|llc|press|bank)\b"
)
#: Layouts: (pattern, group of the family name, group of the given names, whether the given names are bare initials).
LAYOUTS = (
    ((rf"({FAMILY})\s*,\s*({INITIALS}|{GIVEN})", 1, 2, False), (rf"({GIVEN})\s+({FAMILY})", 2, 1, False)),
    ((rf"({INITIALS})\s*({FAMILY})", 2, 1, False), (rf"({GIVEN})\s+({FAMILY})", 2, 1, False)),
    ((rf"({FAMILY})\s+(\p{{Lu}}{{1,4}})(?!\p{{L}})", 1, 2, True),),
)
#: Part of a block that its names must explain.
LEAST = 0.85
AUTHOR = "struct<family:string,given:string,organization:boolean>"


def _cut(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def scanned(block: Column, layout: tuple) -> Column:
    """struct<consumed,authors> of one layout."""
    steps = F.sequence(F.lit(1), F.regexp_count(block, F.lit(SEPARATOR)) + 1)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("consumed"), F.lit(True).alias("more"), F.array().cast(f"array<{AUTHOR}>").alias("authors"))

    def name(rest: Column, hits: Column) -> Column:
        out = F.lit(None).cast(AUTHOR)
        for i, (pattern, family, given, bare) in reversed(list(enumerate(layout))):
            g = F.regexp_extract(rest, f"^(?:{pattern})", given)
            g = F.array_join(F.transform(F.filter(F.split(g, ""), lambda c: c != ""), lambda c: F.concat(c, F.lit("."))), " ") if bare else F.regexp_replace(F.trim(F.regexp_replace(g, r"\s+", " ")), r"\s*-\s*", "-")
            one = F.struct(F.trim(F.regexp_extract(rest, f"^(?:{pattern})", family)).alias("family"), g.alias("given"), F.lit(False).alias("organization")).cast(AUTHOR)
            out = F.when(hits[i] != "", one).otherwise(out)
        return out

    def taken(a: Column, rest: Column, hits: Column) -> Column:
        hit = F.coalesce(F.try_element_at(F.filter(hits, lambda h: h != ""), F.lit(1)), F.lit(""))
        ended = F.struct(a["at"].alias("at"), a["consumed"].alias("consumed"), F.lit(False).alias("more"), a["authors"].alias("authors"))

        def after(n: Column) -> Column:
            return let(F.length(F.regexp_extract(_cut(rest, n), f"^{SEPARATOR}", 0)), lambda gap: F.struct((a["at"] + n + gap).alias("at"), (a["at"] + n).alias("consumed"), (gap > 0).alias("more"), F.array_append(a["authors"], name(rest, hits)).alias("authors")))

        return let(F.length(hit), lambda n: F.when(n > 0, after(n)).otherwise(ended))

    def step(a: Column, _: Column) -> Column:
        found = lambda rest: F.array(*[F.regexp_extract(rest, f"^(?:{p})", 0) for p, *_ in layout])
        return F.when(a["more"], let(_cut(block, a["at"]), lambda rest: let(found(rest), lambda hits: taken(a, rest, hits)))).otherwise(a)

    return F.aggregate(steps, begin, step, lambda a: F.struct(a["consumed"].alias("consumed"), a["authors"].alias("authors")))


def _read(block: Column) -> Column:
    organization = F.array(F.struct(block.alias("family"), F.lit(None).cast("string").alias("given"), F.lit(True).alias("organization")).cast(AUTHOR))

    def tried(i: int, layout: tuple) -> Column:
        return let(scanned(block, layout), lambda s: F.struct(F.when(F.size(s["authors"]) > 0, s["consumed"]).otherwise(0).alias("consumed"), F.size(s["authors"]).alias("n"), F.lit(-i).alias("first"), s["authors"].alias("authors")))

    initials = block.rlike(r",\s*\p{Lu}\.") | block.rlike(r"(?:^|\s)\p{Lu}\.\s*\p{Lu}")
    body = block.rlike(ORGANISATION) & ~initials & ~block.rlike(r"\sand\s\p{Lu}\p{Ll}+\s\p{Lu}\p{Ll}+$")
    alone = block.rlike(r"^\p{Lu}[\p{L}&'’\-. ]{2,}$") & ~block.contains(",")
    best = F.array_max(F.array(*[tried(i, x) for i, x in enumerate(LAYOUTS)]))
    scan = let(best, lambda b: F.when((b["n"] > 0) & (b["consumed"] >= LEAST * F.length(block)), b["authors"]).when(alone, organization).otherwise(b["authors"]))
    return F.when(block == "", F.array().cast(f"array<{AUTHOR}>")).when(body, organization).otherwise(scan)


def parsed(raw: Column) -> Column:
    """struct<authors,truncated> of an author block. Of layouts that explain as much, the one with most names, then the first, wins."""
    block = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[,;:\s]+$", ""), r"([\p{Ll}0-9)])\.$", "$1")
    bare = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?i),?\s*\bet\s+al\.?$", ""), r"\s*\.\.\.\s*", ", "))
    return let(block, lambda b: F.struct(let(bare(b), _read).alias("authors"), b.rlike(r"(?i)\bet\s+al\.?$").alias("truncated")))
