"""From runs to a review of a document: citations beside copies, source excerpts, kinds of issues, unions of sources, warnings;
and the cutting of texts for it: front matter, prose, chunks of sentences, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import citations as C
from inkwell.operators.overlap import sentence_words, verdict
from inkwell.tables import stored

#: Headings that end the prose of a text; words of author blocks; headings of abstracts.
LIST_HEADING = r"(?i)^(?:references|bibliography|works cited|literature cited|reference list)\s*:?$"
AFFILIATION = r"(?i)@|(?:^|[^A-Za-z])(?:dept|department|university|institute|college|school|faculty|laboratory|laboratories)(?:[^A-Za-z]|$)"
ABSTRACT = r"(?i)(?:^|\n)[ \t]*(?:abstract|a\s?b\s?s\s?t\s?r\s?a\s?c\s?t|summary)(?:[^A-Za-z0-9_]|$)"
BLANK_LINE = r"\n[ \t]*\n\s*"
SENTENCE_END = r"\p{Ll}{2}[.!?][\"”’)]?(?:\s|$)"


def sentence_citations(docs: DataFrame) -> DataFrame:
    """doc_id, ix, start, words, citation: the word range of each sentence and the first in-text citation in it (null if none)."""
    found = lambda s, p: F.nullif(F.regexp_extract(s, f"({p})", 1), F.lit(""))
    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "s"))
    dated = F.try_element_at(F.filter(F.regexp_extract_all("s", F.lit(C.PARENTHESES), F.lit(1)), lambda x: x.rlike("(?:19|20)[0-9]{2}") & x.rlike(r"\p{Lu}\p{L}")), F.lit(1))
    raw = F.coalesce(found(F.col("s"), C.NUMERIC), F.concat(F.lit("("), dated, F.lit(")")), found(F.col("s"), C.NARRATIVE))
    return sentence_words(docs).join(s.select("doc_id", "ix", raw.alias("citation")), ["doc_id", "ix"])


def cited(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans (doc_id, start, end in words) with citation: the first one in the sentences that a span touches, null if none."""
    s = sentence_citations(docs).where("citation is not null").select("doc_id", F.col("start").alias("s"), F.col("words").alias("w"), "ix", "citation")
    hit = spans.join(s, "doc_id").where((F.col("s") < F.col("end")) & (F.col("s") + F.col("w") > F.col("start")))
    first = hit.groupBy("doc_id", "start", "end").agg(F.min_by("citation", "ix").alias("citation"))
    return spans.join(first, ["doc_id", "start", "end"], "left")


def excerpts(spans: DataFrame, runs: DataFrame, sources: DataFrame, around: int = 15) -> DataFrame:
    """doc_id, start, end, source_id, excerpt: the credited source's own wording for a span with `around` words on either side.

    Of the source's runs the one that shares most words with the span counts (the first on ties)."""
    r = runs.select("doc_id", "source_id", F.col("start").alias("rs"), F.col("end").alias("re"), "source_start")
    both = spans.select("doc_id", "start", "end", "source_id").join(r, ["doc_id", "source_id"]).withColumn("o", F.least("re", "end") - F.greatest("rs", "start")).where("o > 0")
    best = both.groupBy("doc_id", "start", "end", "source_id").agg(F.max_by(F.struct("rs", "re", "source_start"), F.struct("o", -F.col("rs"), -F.col("source_start"))).alias("b"))
    first = F.col("b.source_start") + F.greatest(F.lit(0), F.col("start") - F.col("b.rs"))
    size = F.greatest(F.lit(1), F.least("b.re", "end") - F.greatest("b.rs", "start"))
    text = F.coalesce("text", F.lit(""))
    s = sources.select("source_id", T.raw_words(text).alias("raws"), F.split(text, T.WORD, -1).alias("gaps"))
    j = best.join(s, "source_id").withColumn("a", F.least(first, F.size("raws") - 1)).withColumn("z", F.least(F.col("a") + size - 1, F.size("raws") - 1))
    j = j.withColumn("from", F.greatest(F.lit(0), F.col("a") - around)).withColumn("to", F.least(F.size("raws") - 1, F.col("z") + around))
    piece = F.transform(F.sequence(F.col("from"), F.col("to")), lambda i: F.concat(F.when(i > F.col("from"), F.element_at("gaps", (i + 1).cast("int"))).otherwise(F.lit("")), F.element_at("raws", (i + 1).cast("int"))))
    dots = lambda more: F.when(more, F.lit("…")).otherwise(F.lit(""))
    out = F.concat(dots(F.col("from") > 0), F.array_join(piece, ""), dots(F.col("to") < F.size("raws") - 1))
    return j.select("doc_id", "start", "end", "source_id", F.regexp_replace(out, r"\s+", " ").alias("excerpt"))


def report(similarity: DataFrame, spans: DataFrame, quotations: DataFrame) -> DataFrame:
    """One row a document: similarity's columns, words copied with and without a citation, quotations, warnings.

    spans: doc_id, start, end, citation; quotations: doc_id."""
    n = F.col("end") - F.col("start")
    w = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    s = spans.groupBy("doc_id").agg(w(F.col("citation").isNotNull()).alias("copied_cited"), w(F.col("citation").isNull()).alias("copied_uncited"))
    q = quotations.groupBy("doc_id").agg(F.count("*").alias("quotations"))
    d = similarity.join(s, "doc_id", "left").join(q, "doc_id", "left").na.fill(0, ["copied_cited", "copied_uncited", "quotations"])
    return d.withColumn("warnings", text_warnings(F.col("words"), F.col("copied_uncited")))


def text_warnings(words: Column, uncited: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(words < 8, F.lit("The text is too short for a meaningful check.")), F.when(uncited > 0, F.concat(uncited.cast("string"), F.lit(" words are copied without a citation."))))), " ")


def provider_warnings(stats: DataFrame) -> DataFrame:
    """provider, warning: what a reader is told of providers that failed (provider, queries, failures)."""
    all_ = F.concat("provider", F.lit(" could not be searched this time, so it contributed nothing."))
    some = F.concat("provider", F.lit(" could not be searched for "), F.col("failures").cast("string"), F.lit(" of "), F.col("queries").cast("string"), F.lit(" passages."))
    return stats.where("failures > 0").select("provider", F.when(F.col("failures") == F.col("queries"), all_).otherwise(some).alias("warning"))


def first_by_id(*parts: DataFrame) -> DataFrame:
    """The union of parts (source_id, kind, text); of rows with one source_id, those of the earliest part stay (the least text on ties)."""
    rows = None
    for k, p in enumerate(parts):
        p = p.select("source_id", "kind", "text", F.lit(k).alias("_part"))
        rows = p if rows is None else rows.unionByName(p)
    best = rows.groupBy("source_id").agg(F.min(F.struct("_part", "text", "kind")).alias("b"))
    return best.select("source_id", "b.kind", "b.text")


def own_works(sources: DataFrame, dois: DataFrame) -> DataFrame:
    """sources (doi, kind, ...) with kind 'own' where the doi is among the author's dois, case aside."""
    mine = dois.select(F.lower("doi").alias("_doi")).where("_doi is not null").distinct().withColumn("_own", F.lit(True))
    s = sources.join(mine, F.lower("doi") == F.col("_doi"), "left")
    return s.withColumn("kind", F.when(F.col("_own"), F.lit("own")).otherwise(F.col("kind"))).drop("_doi", "_own")


def own_documents(works: DataFrame, people: DataFrame, most: int = 40) -> DataFrame:
    """who, source_id, title, text, year of the latest `most` works of each person (who, family, given) as sources of kind own.

    works: work_id, title, abstract, year, doi, authors. Names are compared without case; an initial fits a given name that begins
    with it. The limit is the feature: an author's latest works are what a text is compared with."""
    a = works.select("work_id", "title", "abstract", "year", "doi", F.explode("authors").alias("a")).where(~F.col("a.organization"))
    a = a.select("work_id", "title", "abstract", "year", "doi", F.lower("a.family").alias("_f"), F.lower(F.coalesce("a.given", F.lit(""))).alias("_g"))
    p = people.select("who", F.lower("family").alias("_f"), F.regexp_replace(F.lower(F.coalesce("given", F.lit(""))), r"\.$", "").alias("_p"))
    j = a.join(p, "_f").where(F.startswith("_g", "_p")).dropDuplicates(["who", "work_id"])
    j = j.withColumn("n", F.row_number().over(W.partitionBy("who").orderBy(F.col("year").desc_nulls_last(), "work_id"))).where(F.col("n") <= most)
    known = F.coalesce(F.concat(F.lit("own:doi:"), F.lower("doi")), F.concat(F.lit("own:"), F.col("work_id").cast("string")))
    out = j.select("who", known.alias("source_id"), "title", F.concat_ws(". ", "title", F.nullif("abstract", F.lit(""))).alias("text"), "year")
    return out.where(F.length("text") > 40)


def upgraded(sources: DataFrame, full: DataFrame) -> DataFrame:
    """sources (source_id, text) with the full text (source_id, text; the longest of a source) where that is longer."""
    f = full.groupBy("source_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("_full"))
    better = F.length("_full") > F.length(F.coalesce("text", F.lit("")))
    return sources.join(f, "source_id", "left").withColumn("upgraded", F.coalesce(better, F.lit(False))).withColumn("text", F.when(F.col("upgraded"), F.col("_full")).otherwise(F.col("text"))).drop("_full")


def upgraded_runs(docs: DataFrame, sources: DataFrame, full: DataFrame, runs_of: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sources as used, runs): matched sources are compared in full; one whose full text has no run keeps its old text and runs.

    runs_of(docs, sources) gives runs with doc_id, source_id, start, end. Sources without a match at first are not looked up."""
    old = runs_of(docs, sources)
    matched = old.select("source_id").distinct()
    longer = upgraded(sources.join(matched, "source_id", "left_semi"), full)
    new = runs_of(docs, longer.where("upgraded"))
    again = new.select("source_id").distinct().withColumn("_again", F.lit(True))
    used = longer.select("source_id", "upgraded", F.col("text").alias("_text")).join(again, "source_id", "left").withColumn("upgraded", F.col("upgraded") & F.col("_again").isNotNull())
    used = sources.join(used, "source_id").select("source_id", "upgraded", F.when(F.col("upgraded"), F.col("_text")).otherwise(F.col("text")).alias("text"))
    kept = old.join(used.where("not upgraded").select("source_id"), "source_id", "left_semi").select(new.columns)
    return used, new.unionByName(kept)


def hidden(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text, count of ranges (doc_id, start, end in characters) that lie inside their document."""
    j = ranges.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")), "doc_id").where((F.col("end") > F.col("start")) & (F.col("end") <= F.length("_t")) & (F.col("start") >= 0))
    size = (F.col("end") - F.col("start")).cast("int")
    return j.select("doc_id", "start", "end", F.substring("_t", (F.col("start") + 1).cast("int"), size).alias("text"), size.alias("count"))


def front_matter(text: Column) -> Column:
    """struct<start,end>: what stands between the title line and the abstract, if it looks like an author block (null if not)."""
    head = F.substring(text, 1, 6000)
    before = F.element_at(F.split(head, ABSTRACT, 2), 1)
    start = F.instr(text, "\n") - 1
    end = F.when(F.length(before) == F.length(head), F.lit(-1)).otherwise(F.length(before) + F.when(F.substring(head, F.length(before) + 1, F.lit(1)) == "\n", 1).otherwise(0))
    at = F.length(before)
    lines = F.filter(F.transform(F.split(F.substring(text, start + 1, F.greatest(at - start, F.lit(0))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.forall(lines, lambda x: F.size(F.split(x, r"\s+")) <= 12)
    good = (end >= 0) & (start >= 0) & (start < at) & (F.size(lines) > 0) & (F.exists(lines, lambda x: x.rlike(AFFILIATION)) | short)
    return F.when(good, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def prose(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: paragraphs of 30 words, or of 12 with a sentence's end, before the list of references; else the whole text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select("doc_id", F.length("t").alias("all"), F.posexplode(F.arrays_zip(F.split("t", BLANK_LINE, -1).alias("p"), F.regexp_extract_all("t", F.lit(f"({BLANK_LINE})"), F.lit(1)).alias("s"))).alias("ix", "x"))
    d = d.select("doc_id", "all", "ix", F.col("x.p").alias("p"), F.coalesce("x.s", F.lit("")).alias("sep"))
    upto = F.sum(F.length("p") + F.length("sep")).over(W.partitionBy("doc_id").orderBy("ix"))
    bare = F.regexp_replace("p", r"^\s+|\s+$", "")
    d = d.withColumn("body", bare).withColumn("start", upto - F.length("p") - F.length("sep") + F.length("p") - F.length(F.regexp_replace("p", r"^\s+", "")))
    stop = F.min(F.when(F.col("body").rlike(LIST_HEADING), F.col("ix"))).over(W.partitionBy("doc_id"))
    n = F.regexp_count("body", F.lit(r"[\p{L}\p{N}]+"))
    d = d.withColumn("good", (F.col("ix") < F.coalesce(stop, F.lit(1 << 30))) & ((n >= 30) | ((n >= 12) & F.col("body").rlike(SENTENCE_END))))
    kept = F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.max("all").cast("long").alias("end")))
    return d.groupBy("doc_id").agg(F.when(F.count_if(F.col("good")) > 0, kept).otherwise(whole).alias("r")).select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.*")


def chunks(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, ix, text: sentences joined by blanks up to `most` characters; a longer sentence is a chunk of its own."""
    s = docs.select("doc_id", T.simple_sentences(F.coalesce("text", F.lit(""))).alias("ss")).where(F.size("ss") > 0)
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(1 << 30).alias("size"), F.lit(1).alias("at"))

    def step(a: Column, n: Column) -> Column:
        new = a["size"] + 1 + n > most
        return F.struct(F.when(new, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"), F.when(new, n).otherwise(a["size"] + 1 + n).alias("size"), (a["at"] + 1).alias("at"))

    s = s.withColumn("starts", F.aggregate(F.transform("ss", lambda x: F.length(x)), begin, step)["starts"])
    s = s.select("doc_id", "ss", "starts", F.posexplode("starts").alias("ix", "first"))
    last = F.coalesce(F.try_element_at("starts", F.col("ix") + 2), F.size("ss") + 1)
    return s.select("doc_id", "ix", F.array_join(F.slice("ss", F.col("first"), last - F.col("first")), " ").alias("text"))


def assembled(pieces: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, text, changed: pieces (doc_id, ix, text) put together again, with replacements (doc_id, ix, new) where there are any."""
    j = pieces.join(replacements, ["doc_id", "ix"], "left").withColumn("now", F.coalesce("new", "text"))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "now"))), lambda x: x["now"]), " ").alias("text"), F.count_if(F.col("now") != F.col("text")).alias("changed"))


def untagged(text: Column) -> Column:
    """Corpus text with word/tag pairs as plain text: tags go, blanks before marks and inside quotes too."""
    t = F.regexp_replace(text, r"(\S+)/[a-zA-Z$*+.,:()'`-]+(?=\s|$)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"``\s*", '"'), r"\s*''", '"')
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:?!])", "$1"), r"\s+", " "))


def corpus_windows(docs: DataFrame, size: int = 300, most: int = 150) -> DataFrame:
    """source, doc_id, ix, words: whole windows of `size` words; the first `most` of a source by doc_id and place.

    The cap is what the corpus asks for. No text moves, and no source is ordered whole: documents are parted by ranges of source and
    id, sums by range tell where the cap falls, and only documents of ranges up to there are ranked, each range by itself."""
    n = docs.select("source", "doc_id", F.floor(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")) / size).alias("w"))
    # written before it is parted, since ranges are found by a pass over the rows of their own
    n = stored(stored(n, "windows").where("w > 0").repartitionByRange("source", "doc_id").withColumn("part", F.spark_partition_id()), "windows-parted")
    upto = lambda c, *by: F.sum(c).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, W.currentRow))
    per = n.groupBy("source", "part").agg(F.sum("w").alias("all"))
    per = per.select(F.col("source").alias("_s"), F.col("part").alias("_p"), (upto("all", "source", "part") - F.col("all")).alias("first")).where(F.col("first") < most)
    d = n.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    d = d.withColumn("left", F.lit(most) - F.col("first") - (upto("w", "source", "part", "doc_id") - F.col("w"))).where("left > 0")
    return d.select("source", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least("w", "left") - 1)).alias("ix")).select("source", "doc_id", "ix", F.lit(size).alias("words"))


def basic_tokens(text: Column) -> Column:
    """Lower-cased words without marks of accents, punctuation apart: what a wordpiece model starts from."""
    t = F.translate(F.lower(text), T.MARKED, T.BARE)
    return T.matches(F.regexp_replace(t, "[̀-ͯ]", ""), r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")
