"""Citations: reference lists, identifiers, in-text citations and their cross-check, matching with works, claims, formats.

Works have columns work_id, title, authors array<struct<family, given, organization>>, year, container, volume, issue, pages,
doi, url, publisher, type, arxiv_id, citations, abstract, retraction, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T

BRACKET = r"^\s*\[([0-9]{1,3})\]\s*"
DOT = r"^\s*([0-9]{1,3})[.)]\s+"
SURNAME = r"^\s*(?:\p{Lu}[\p{L}'’\-]+(?:\s+\p{Lu}[\p{L}'’\-]+)?\s*,\s*\p{Lu}|\p{Lu}\.\s*(?:\p{Lu}\.\s*)*\p{Lu}[\p{L}'’\-]+|\p{Lu}[\p{L}'’\-]+\s+\p{Lu}{1,3}[,.])"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
_GROUP = rf"(?:(?:van|von|de|der|den|di|da|del|la|le|bin|al|el|ter|ten|du)\s+)*{_NAME}(?:\s+{_NAME})*"
NUMERIC = r"\[([0-9]{1,3}(?:\s*[,;–\-]\s*[0-9]{1,3})*)\]"
PARENTHESES = r"\(([^()]{3,300})\)"
NARRATIVE = rf"({_GROUP})(?:\s+(?:and|&)\s+{_NAME}|\s+et\s+al\.?)?\s*\(((?:19|20)[0-9]{{2}})([a-z])?(?:,\s*p+\.\s*[0-9–-]+)?\)"
PART = rf"^(?:(?:see|e\.g\.,?|cf\.|also|but see|compare)\s+)?({_GROUP})(?:\s*(?:,|and|&)\s*{_GROUP})*?(?:\s+et\s+al\.?)?,?\s*((?:19|20)[0-9]{{2}})([a-z])?"
#: Words that stand before a bracketed year and are no names.
NO_NAME = r"^(?:In|On|At|By|From|Since|During|Until|Before|After|Between|Through|Throughout|Early|Late|Mid)$"
DOI = r"(10\.[0-9]{4,9}/[^\s\"<>]+)"
ARXIV = r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Za-z]{2})?/[0-9]{7})"


def joined_lines(lines: Column) -> Column:
    """Lines of one entry: words hyphenated at line ends become whole, white space single."""
    t = F.regexp_replace(F.array_join(lines, "\n"), r"([^\s])-\n\s*([a-z])", "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def split_references(lists: DataFrame) -> DataFrame:
    """doc_id, index (from 1), raw: entries of reference lists (doc_id, text), by [n] or n. markers where a quarter of the lines
    (two at least) have them, else by blank lines, else by lines that open with a name."""
    lines = lists.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("ix", "line"))
    doc = W.partitionBy("doc_id")
    full = F.regexp_replace("line", r"\s", "") != ""
    lines = lines.withColumn("full", full).withColumn("n", F.count_if("full").over(doc))
    lines = lines.withColumn("brackets", F.count_if(F.col("line").rlike(BRACKET)).over(doc)).withColumn("dots", F.count_if(F.col("line").rlike(DOT)).over(doc))
    least = F.greatest(F.lit(2), F.floor(F.col("n") * 0.25))
    # blocks between blank lines
    order = doc.orderBy("ix").rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = F.col("full") & ~F.coalesce(F.lag("full").over(doc.orderBy("ix")), F.lit(False))
    lines = lines.withColumn("opens", opens).withColumn("blocks", F.count_if("opens").over(doc))
    named = F.col("line").rlike(SURNAME) | (F.count_if("full").over(order) == 1)
    kind = F.when(F.col("brackets") >= least, "bracket").when(F.col("dots") >= least, "dot").when(F.col("blocks") >= 2, "block").otherwise("name")
    lines = lines.withColumn("kind", kind).withColumn("named", named & F.col("full"))
    start = F.when(F.col("kind") == "bracket", F.col("line").rlike(BRACKET)).when(F.col("kind") == "dot", F.col("line").rlike(DOT)).when(F.col("kind") == "block", F.col("opens")).otherwise(F.col("named"))
    lines = lines.where("full").withColumn("entry", F.sum(start.cast("int")).over(order)).where("entry > 0")
    bare = F.when(F.col("kind") == "bracket", F.regexp_replace("line", BRACKET, "")).when(F.col("kind") == "dot", F.regexp_replace("line", DOT, "")).otherwise(F.col("line"))
    g = lines.withColumn("line", bare).groupBy("doc_id", "entry").agg(F.array_sort(F.collect_list(F.struct("ix", "line"))).alias("l"))
    return g.select("doc_id", F.col("entry").cast("int").alias("index"), joined_lines(F.transform("l", lambda x: x["line"])).alias("raw"))


def doi(text: Column) -> Column:
    """The first DOI, lower case, without trailing marks; null if none."""
    found = F.lower(F.regexp_replace(F.regexp_extract(text, DOI, 1), r"[.,;:)\]}>]+$", ""))
    return F.when(found != "", found)


def identifiers(references: DataFrame, now: int = 2026) -> DataFrame:
    """Adds doi, arxiv_id, url, year, year_suffix, title and lead (what stands before the year) to entries with a column raw.

    The year is the first plausible one in brackets, or else the last bare one. The title is read from the author-year layout:
    the sentence after the bracketed year, or what is quoted first."""
    raw = F.col("raw")
    url = F.regexp_replace(F.regexp_extract(raw, r"(https?://[^\s\"<>]+)", 1), r"[.,;)]+$", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, rf"(?i)(?:doi:?\s*|https?://(?:dx\.)?doi\.org/)?{DOI}", " "), r"https?://[^\s\"<>]+", " "), r"(?i)arxiv:\s*\S+", " ")
    paren = F.regexp_extract_all(body, F.lit(r"(?:^|[^0-9])\(\s*([0-9]{4}[a-z]?)\s*[,)]"), F.lit(1))
    good = F.try_element_at(F.filter(paren, lambda y: F.left(y, F.lit(4)).cast("int").between(1500, now + 1)), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(body, r"\s", "  "), F.lit(r"(?:^|[^0-9–-])((?:18|19|20)[0-9]{2}[a-z]?)(?:$|[^0-9–)a-z-])"), F.lit(1))
    last = F.try_element_at(F.filter(bare, lambda y: F.left(y, F.lit(4)).cast("int") <= now + 1), F.lit(-1))
    y = F.coalesce(good, last)
    null = lambda c: F.when(c != "", c)
    after = F.regexp_extract(body, r"\(\s*[0-9]{4}[a-z]?\s*[,)][^)]*?[\s.,:)]*(\S.*)$", 1)
    quoted = F.regexp_extract(body, r"[“\"]([^“”\"]{6,}?)[.,]?[”\"]", 1)
    title = F.coalesce(F.when(good.isNotNull(), null(F.regexp_replace(F.regexp_extract(after, r"^(.+?)(?:\.\s+[\p{Lu}*_“\"(0-9]|\.?\s*$)", 1), r"[*_]", ""))), null(quoted))
    out = references.withColumn("doi", doi(raw)).withColumn("arxiv_id", null(F.regexp_extract(raw, ARXIV, 1))).withColumn("url", F.when((url != "") & ~url.rlike("(?i)doi\\.org/"), url))
    out = out.withColumn("year", F.left(y, F.lit(4)).cast("int")).withColumn("year_suffix", null(F.substring(y, 5, 1)))
    return out.withColumn("title", title).withColumn("lead", F.when(good.isNotNull(), F.regexp_replace(F.regexp_extract(body, r"^(.*?)\(\s*[0-9]{4}", 1), r"[\s,;:.]+$", "")))


def completeness(author: Column, year: Column, title: Column, container: Column, doi_: Column) -> Column:
    has = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    return F.round(has(author, 0.25) + has(year, 0.2) + has(title, 0.3) + has(container, 0.15) + has(doi_, 0.1), 2)


def in_text(docs: DataFrame) -> DataFrame:
    """doc_id, kind, ix (order inside its kind), raw, numbers, surname, year, year_suffix."""
    text = F.coalesce("text", F.lit(""))
    none = lambda t: F.lit(None).cast(t)
    n = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1))).alias("ix", "spec"))
    n = n.select("doc_id", F.lit("numeric").alias("kind"), "ix", F.concat(F.lit("["), "spec", F.lit("]")).alias("raw"), T.expand_numbers(F.col("spec")).alias("numbers"), none("string").alias("surname"), none("int").alias("year"), none("string").alias("year_suffix"))
    p = docs.select("doc_id", F.regexp_extract_all(text, F.lit(PARENTHESES), F.lit(1)).alias("ps"))
    parts = F.transform(F.flatten(F.transform(F.filter("ps", lambda x: x.rlike("(?:19|20)[0-9]{2}")), lambda x: F.split(x, ";"))), lambda x: F.trim(x))
    p = p.select("doc_id", F.posexplode(F.filter(parts, lambda x: x.rlike(PART))).alias("ix", "raw"))
    a = docs.select("doc_id", F.posexplode(T.matches(text, NARRATIVE)).alias("ix", "raw"))
    names = lambda df, pattern, kind: df.select("doc_id", F.lit(kind).alias("kind"), "ix", "raw", none("array<int>").alias("numbers"), F.regexp_extract("raw", pattern, 1).alias("surname"), F.regexp_extract("raw", pattern, 2).cast("int").alias("year"), F.regexp_extract("raw", pattern, 3).alias("s"))
    b = names(p, PART, "parenthetical").unionByName(names(a, NARRATIVE, "narrative").where(~F.col("surname").rlike(NO_NAME)))
    return n.unionByName(b.withColumn("year_suffix", F.when(F.col("s") != "", F.col("s"))).drop("s"))


def plain(s: Column) -> Column:
    """A name for comparing: no marks, lower case, letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.lower(F.translate(s, T.MARKED, T.BARE)), "[^a-z0-9 ]", ""))


def same_surname(cited: Column, family: Column, organization: Column) -> Column:
    s, f = plain(cited), plain(family)
    ends = lambda a, b: F.endswith(a, F.concat(F.lit(" "), b))
    return (f == s) | ends(f, s) | ends(s, f) | (organization & (F.startswith(f, s) | F.startswith(s, f)))


def cross_check(citations: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(missing: doc_id, raw, reason), (uncited: doc_id, index), (style: doc_id, style, out_of_order).

    references: doc_id, index, family (of the first author), organization, year, year_suffix."""
    r = references.select("doc_id", "index", "family", "organization", F.col("year").alias("r_year"), F.col("year_suffix").alias("r_suffix"))
    n = citations.where("kind = 'numeric'").select("doc_id", "ix", "raw", F.explode("numbers").alias("n"))
    known = r.select("doc_id", F.col("index").alias("n"))
    lost = n.join(known, ["doc_id", "n"], "left_anti").select("doc_id", "raw", F.concat(F.lit("no reference "), F.col("n").cast("string")).alias("reason"))
    a = citations.where("kind != 'numeric'").withColumn("c", F.struct("kind", "ix")).join(r, "doc_id", "left")
    same = F.coalesce(same_surname(F.col("surname"), F.col("family"), F.col("organization")), F.lit(False))
    exact = same & (F.col("r_year") == F.col("year")) & (F.col("year_suffix").isNull() | F.col("r_suffix").isNull() | (F.col("year_suffix") == F.col("r_suffix")))
    g = a.withColumn("same", same).withColumn("exact", F.coalesce(exact, F.lit(False)))
    outcome = g.groupBy("doc_id", "c", "raw").agg(F.max("exact").alias("exact"), F.max("same").alias("same"))
    gone = outcome.where("not exact").select("doc_id", "raw", F.when(F.col("same"), "other year").otherwise("no such author").alias("reason"))
    cited = n.join(known, ["doc_id", "n"]).select("doc_id", F.col("n").alias("index")).union(g.where("exact").select("doc_id", "index")).distinct()
    uncited = references.select("doc_id", "index").join(cited, ["doc_id", "index"], "left_anti")
    first = n.withColumn("o", F.struct("ix", F.col("n"))).groupBy("doc_id", "n").agg(F.min("ix").alias("ix"))
    first = first.withColumn("i", F.row_number().over(W.partitionBy("doc_id").orderBy("ix", "n")))
    order = first.groupBy("doc_id").agg(((F.count("*") > 2) & (F.max(F.col("i") != F.col("n")))).alias("odd"))
    s = citations.groupBy("doc_id").agg(F.count_if(F.col("kind") == "numeric").alias("n"), F.count_if(F.col("kind") != "numeric").alias("a"))
    s = s.join(order, "doc_id", "left")
    style = F.when((F.col("n") > 0) & (F.col("a") > 0), "mixed").when(F.col("n") > 0, "numeric").otherwise("author-year")
    return lost.unionByName(gone), uncited, s.select("doc_id", style.alias("style"), ((F.col("n") >= 5) & F.coalesce("odd", F.lit(False))).alias("out_of_order"))


# matching


def same_family(a: Column, b: Column) -> Column:
    x, y = plain(a["family"]), plain(b["family"])
    ends = lambda p, q: F.endswith(p, F.concat(F.lit(" "), q))
    given = lambda s: F.filter(F.split(plain(F.coalesce(s["given"], F.lit(""))), " "), lambda w: F.length(w) > 2)
    return (x != "") & (y != "") & ((x == y) | ends(x, y) | ends(y, x) | (a["organization"] & (F.startswith(x, y) | F.startswith(y, x))) | F.array_contains(given(b), x) | F.array_contains(given(a), y))


def container_similarity(a: Column, b: Column) -> Column:
    """Dice of tokens, or the share of the shorter name's tokens that begin tokens of the longer one, times 0.9."""
    ta, tb = T.title_tokens(a), T.title_tokens(b)
    short, long = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    fits = F.filter(short, lambda s: F.exists(long, lambda x: F.startswith(x, s) | ((F.length(s) >= 3) & F.startswith(x, F.left(s, F.lit(3))) & (F.length(s) < F.length(x)))))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.greatest(T.dice(ta, tb), F.size(fits) / F.size(short) * 0.9))


def contained(title: Column, haystack: Column) -> Column:
    t, h = T.title_tokens(title), T.title_tokens(haystack)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda x: F.array_contains(h, x))) / F.size(t))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds title_score, author_score, year_score, container_score, score to pairs of struct columns r (raw, title, authors, year,
    container) and w (a work). Missing fields don't count against a pair."""
    r, w = F.col("r"), F.col("w")
    k = F.size(T.title_tokens(w["title"]))
    inside = contained(w["title"], r["raw"])
    weighted = inside * F.when(k >= 5, 0.9).when(k >= 3, 0.6).otherwise(0.4)
    title = F.when(r["title"].isNotNull(), F.greatest(T.title_similarity(F.coalesce(r["title"], F.lit("")), w["title"]), weighted)).otherwise(weighted / 0.9)
    few = F.slice(r["authors"], 1, 3)
    authors = F.when((F.size(few) > 0) & (F.size(w["authors"]) > 0), F.size(F.filter(few, lambda a: F.exists(w["authors"], lambda b: same_family(a, b)))) / F.size(few))
    apart = F.abs(r["year"] - w["year"])
    year = F.when(apart == 0, 1.0).when(apart == 1, 0.6).when(apart > 1, 0.0)
    container = F.when(r["container"].isNotNull() & w["container"].isNotNull(), container_similarity(r["container"], w["container"]))
    p = pairs.withColumn("title_score", title).withColumn("author_score", authors).withColumn("year_score", year).withColumn("container_score", container)
    weights = {"title_score": 0.55, "author_score": 0.15, "year_score": 0.15, "container_score": 0.15}
    total = sum((F.when(F.col(c).isNotNull(), x).otherwise(0.0) for c, x in weights.items()), F.lit(0.0))
    got = sum((F.coalesce(F.col(c) * x, F.lit(0.0)) for c, x in weights.items()), F.lit(0.0))
    return p.withColumn("score", F.round(got / total, 3)).withColumn("title_score", F.round("title_score", 3))


def status(score: Column, title: Column, authors: Column, year: Column, container: Column) -> Column:
    """verified, likely or not_found; a record by none of the cited authors needs all else to agree."""
    stranger = F.coalesce(authors == 0, F.lit(False)) & ((title < 0.95) | F.coalesce(year == 0, F.lit(False)) | F.coalesce(container < 0.5, F.lit(False)))
    return F.when(stranger, "not_found").when((score >= 0.82) & (title >= 0.75), "verified").when((score >= 0.62) & (title >= 0.55), "likely").otherwise("not_found")


def discrepancies(r: Column, w: Column) -> Column:
    """array<string> of the fields in which an entry differs from the record."""
    preprint = w["type"].isin("preprint", "posted-content")
    late = preprint & (r["year"] > w["year"]) & (r["year"] - w["year"] <= 2)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    page = lambda c: digits(F.element_at(F.split(F.coalesce(c, F.lit("")), "[-–—]"), 1))
    first = F.try_element_at(r["authors"], F.lit(1))
    lead = F.try_element_at(w["authors"], F.lit(1))
    checks = [
        ("year", (r["year"] != w["year"]) & ~F.coalesce(late, F.lit(False))), ("authors", first.isNotNull() & lead.isNotNull() & ~same_family(first, lead)),
        ("title", r["title"].isNotNull() & (T.title_similarity(F.coalesce(r["title"], F.lit("")), w["title"]) < 0.85) & (contained(w["title"], r["raw"]) < 0.9)),
        ("container", container_similarity(r["container"], w["container"]) < 0.5), ("volume", digits(r["volume"]) != digits(w["volume"])), ("pages", (page(r["pages"]) != "") & (page(w["pages"]) != "") & (page(r["pages"]) != page(w["pages"]))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks]))


def best_matches(references: DataFrame, works: DataFrame) -> DataFrame:
    """ref_id, work_id and scores: the best work for each entry. Candidates share the DOI or a title token of five letters or
    more; a token that many works have costs one row for each, so blocking stays an equi-join. Preprints lose near ties."""
    r = references.select("ref_id", F.struct(*references.columns).alias("r"))
    w = works.select("work_id", F.struct(*works.columns).alias("w"))
    tokens = lambda c: F.array_distinct(F.filter(T.title_tokens(c), lambda t: F.length(t) >= 5))
    keys = lambda s: F.array_compact(F.array_append(F.transform(tokens(F.coalesce(s["title"], s["raw"] if s is R else s["title"], F.lit(""))), lambda t: F.concat(F.lit("t:"), t)), F.concat(F.lit("d:"), s["doi"])))
    R = F.col("r")
    a = r.select("ref_id", F.explode(keys(R)).alias("key"))
    b = w.select("work_id", F.explode(keys(F.col("w"))).alias("key"))
    p = a.join(b, "key").select("ref_id", "work_id").distinct().join(r, "ref_id").join(w, "work_id")
    s = score_pairs(p).withColumn("rank", F.col("score") - F.when(F.col("w.type").isin("preprint", "posted-content"), 0.04).otherwise(0.0))
    s = s.withColumn("n", F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("rank"), "work_id"))).where("n = 1")
    out = s.withColumn("status", status(*[F.col(c) for c in ("score", "title_score", "author_score", "year_score", "container_score")]))
    return out.select("ref_id", "work_id", "score", "title_score", "status", F.array_join(discrepancies(F.col("r"), F.col("w")), ",").alias("differs"))


def duplicates(references: DataFrame) -> DataFrame:
    """doc_id, ref_id, duplicate_of: entries of one list that repeat an earlier one (DOI, else title and year, else raw text).

    Compares within one list, joined on doc_id; an entry that is itself a repeat may be named as the earlier one's repeat."""
    a = references.select("doc_id", "ref_id", "doi", "title", "year", "raw").alias("a")
    b = references.select("doc_id", "ref_id", "doi", "title", "year", "raw").alias("b")
    p = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.ref_id") < F.col("a.ref_id")))
    both = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    same = F.when(both("doi"), F.col("a.doi") == F.col("b.doi")).when(both("title"), (T.title_similarity(F.col("a.title"), F.col("b.title")) >= 0.95) & F.col("a.year").eqNullSafe(F.col("b.year"))).otherwise(T.normal_title(F.col("a.raw")) == T.normal_title(F.col("b.raw")))
    return p.where(same).groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.ref_id").alias("ref_id")).agg(F.min("b.ref_id").alias("duplicate_of"))


STATUSES = ("verified", "likely", "mismatch", "not_found", "unchecked")
#: Flags that say nothing against an entry.
HARMLESS = ("incomplete_reference", "duplicate")


def verification_counts(checks: DataFrame) -> DataFrame:
    """doc_id, a column for each status, flagged: entries of a list by status, and those with a flag that counts (checks: doc_id,
    status, flags array<string>)."""
    bad = F.exists(F.coalesce("flags", F.array().cast("array<string>")), lambda f: ~f.isin(*HARMLESS))
    return checks.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(bad).alias("flagged"))


def corrected_list(checks: DataFrame, works: DataFrame, style: str) -> DataFrame:
    """doc_id, text: each list (doc_id, index, raw, status, work_id) with found entries as their works are formatted, others as they were."""
    made = formatted(works, style).select("work_id", F.col("text").alias("_made"))
    found = F.col("status").isin("verified", "likely", "mismatch") & F.col("_made").isNotNull()
    j = checks.join(made, "work_id", "left").withColumn("line", F.when(found, F.col("_made")).otherwise(F.col("raw")))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("text"))


def corrected_bibtex(checks: DataFrame, works: DataFrame) -> DataFrame:
    """doc_id, text: BibTeX of the works found for each list, in the order of its entries, each work once."""
    first = checks.where(F.col("status").isin("verified", "likely", "mismatch")).groupBy("doc_id", "work_id").agg(F.min("index").alias("index"))
    return first.join(bibtex(works), "work_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def retraction(title: Column, updates: Column, relations: Column) -> Column:
    """A status from update types (array), relation names (array) or the title; null if none."""
    kinds = {"retraction": "retracted", "withdrawal": "withdrawn", "removal": "removed", "expression_of_concern": "expression_of_concern"}
    known = F.try_element_at(F.filter(updates, lambda u: F.lower(u).isin(*kinds)), F.lit(1))
    by_type = F.coalesce(*[F.when(F.lower(known) == k, v) for k, v in kinds.items()])
    related = F.exists(relations, lambda x: x.rlike("(?i)(?:is-)?retracted-by|has-retraction"))
    titled = F.when(title.rlike(r"(?i)^\s*(?:retracted|withdrawn)\s*[:\-–]"), F.when(title.rlike("(?i)^\\s*withdrawn"), "withdrawn").otherwise("retracted"))
    return F.coalesce(by_type, F.when(related, "retracted"), titled)


#: Cues that a sentence needs a citation, and their weights.
CUES = (
    (r"(?:studies|research|evidence|literature|trials|surveys|analyses|reviews|reports|experiments)\s+(?:[A-Za-z0-9_]+\s+){0,3}?(?:show|suggest|indicate|demonstrate|reveal|report|found|confirm|support)", 3, False),
    (r"(?:has|have|had)\s+been\s+(?:[A-Za-z0-9_]+ly\s+)?(?:shown|demonstrated|reported|found|proposed|used|observed|established|documented|suggested|argued)", 3, False),
    (r"according to", 3, True),
    (r"(?:it is|is)\s+(?:well|widely|generally|commonly)\s+(?:known|established|accepted|recognised|recognized|documented)", 3, False),
    (r"[0-9]+(?:\.[0-9]+)?\s?(?:%|percent|per cent|fold|times)", 2, False),
    (r"(?:increased|elevated|reduced|decreased|higher|lower)\s+(?:risk|likelihood|odds|incidence|prevalence|mortality)", 1, True),
    (r"(?:significantly|substantially|markedly)\s+(?:higher|lower|more|less|greater|reduced|increased|improved)", 2, False),
    (r"(?:is|are|was|were)\s+(?:strongly\s+|positively\s+|negatively\s+)?(?:associated|correlated|linked)\s+with", 2, True),
    (r"(?:causes?|leads? to|results? in|contributes? to|increases? the risk|reduces? the risk)", 1, True),
    (r"(?:leading|major|main|primary|most common)\s+(?:cause|reason|factor|source|challenge|limitation)", 2, True),
    (r"(?:typically|commonly|generally|frequently|traditionally|widely)", 1, True),
    (r"(?:is|are)\s+(?:considered|thought|believed|regarded|assumed)\s+to", 2, True),
    (r"(?:growing|increasing|rising)\s+(?:number|evidence|interest|body)", 2, False),
    (r"(?:we|our|this (?:study|paper|work|article|section|chapter)|in this (?:study|paper|work|article|section))", -3, True),
    (r"(?:fig(?:ure)?s?\.?|tables?)\s+[0-9]+\s+(?:shows?|presents?|lists?|summari[sz]es?)", -3, False),
    (r"(?:as (?:shown|described|illustrated) (?:in|below|above)|see (?:section|figure|table))", -3, True),
)


def cue_pattern(cue: str, closed: bool) -> str:
    return f"(?i)(?:^|[^A-Za-z0-9_]){cue}" + ("(?:[^A-Za-z0-9_]|$)" if closed else "")


def claims(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, ix, sentence, score: sentences of eight words or more that probably need a citation and have none."""
    from inkwell.operators.preparing import PROTECTED

    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))
    s = s.where((T.word_count(F.col("sentence")) >= 8) & ~F.col("sentence").rlike(r"\?$") & ~F.col("sentence").rlike(dict(PROTECTED)["cite"]))
    score = sum((F.when(F.col("sentence").rlike(cue_pattern(p, c)), w).otherwise(0) for p, w, c in CUES), F.lit(0))
    return s.withColumn("score", score).where(F.col("score") >= least)


#: Words that say little about a topic.
GENERIC = tuple(
    "study studies research result results show shown shows found finding findings suggest suggests indicate indicates significantly however therefore thus also many much more most several various different similar recent recently "
    "previous previously increasingly widely commonly typically generally often well known based using used use paper work approach method methods analysis case cases new high higher low lower large larger small smaller number data "
    "effect effects possible make makes made allow allows allowed enable enables solely very able".split()
)


def keyphrases(sentences: DataFrame, most: int = 7) -> DataFrame:
    """doc_id, ix, keyphrases (array, in text order): the words that best tell what a sentence is about."""
    t = sentences.select("doc_id", "ix", F.posexplode(T.raw_words(F.col("text"))).alias("pos", "raw")).withColumn("word", T.normal(F.col("raw")))
    acronym = F.col("raw").rlike("^[A-Z]{2,6}$")
    t = t.where(acronym | ~((F.length("word") < 4) | T.is_stopword(F.col("word")) | F.col("word").isin(*GENERIC) | F.col("word").rlike("^[0-9]+$")))
    capital = (F.col("pos") > 0) & F.col("raw").rlike("^[A-Z]") & ~acronym
    value = F.length("word") + F.when(acronym, 4).otherwise(0) + F.when(capital, 3).otherwise(0) + F.when(F.contains("word", F.lit("-")), 2).otherwise(0)
    g = t.withColumn("v", value).groupBy("doc_id", "ix", "word").agg((F.min_by("v", "pos") + F.count("*") - 1).alias("score"), F.min("pos").alias("first"))
    g = g.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "ix").orderBy(F.desc("score"), "first"))).where(F.col("n") <= most)
    return g.groupBy("doc_id", "ix").agg(F.array_sort(F.collect_list(F.struct("first", "word"))).alias("k")).select("doc_id", "ix", F.transform("k", lambda x: x["word"]).alias("keyphrases"))


def rank_works(claims_: DataFrame, works: DataFrame) -> DataFrame:
    """doc_id, ix, work_id, relevance (0.18 or more): works by the key stems they share with a claim (doc_id, ix, text).

    0.55 title + 0.3 abstract + 0.15 neighbours, well-cited works a little up, retracted ones far down. Candidates share a stem."""
    k = keyphrases(claims_, 12).select("doc_id", "ix", F.array_distinct(F.transform("keyphrases", T.stem)).alias("q"))
    stems = lambda c: F.transform(F.filter(T.words(F.coalesce(c, F.lit(""))), lambda w: (F.length(w) > 2) & ~T.is_stopword(w)), T.stem)
    w = works.select("work_id", "citations", "retraction", stems(F.col("title")).alias("t"), stems(F.col("abstract")).alias("a"))
    pairs = k.select("doc_id", "ix", "q", F.explode("q").alias("s")).join(w.select("work_id", F.explode(F.array_distinct(F.concat("t", "a"))).alias("s")), "s").select("doc_id", "ix", "q", "work_id").distinct().join(w, "work_id")
    share = lambda c: F.size(F.array_intersect("q", c)) / F.size("q")
    title = share("t")
    abstract = F.when(F.size("a") > 0, share("a")).otherwise(title * 0.5)
    seq = F.when(F.size("a") > 0, F.concat("t", F.array(F.lit("|")), "a")).otherwise(F.col("t"))
    both = F.zip_with(F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0))), F.slice(seq, 2, F.size(seq)), lambda x, y: F.array_contains("q", x) & F.array_contains("q", y) & (x != y))
    topical = 0.55 * title + 0.3 * abstract + 0.15 * F.least(F.lit(1.0), F.size(F.filter(both, lambda b: b)) / 3)
    prior = F.least(F.lit(1.0), F.log10(1 + F.coalesce("citations", F.lit(0))) / 5)
    p = pairs.withColumn("topical", topical)
    rel = F.when(F.col("topical") >= 0.3, F.col("topical") * 0.75 + prior * 0.25).otherwise(F.col("topical") * 0.75) * F.when(F.col("retraction").isNotNull(), 0.2).otherwise(1.0)
    return p.withColumn("relevance", F.round(rel, 3)).where(F.col("relevance") >= 0.18).select("doc_id", "ix", "work_id", "relevance")


# records


def work_key(w: DataFrame) -> Column:
    title = F.concat(F.lit("title:"), T.normal_title(F.col("title")), F.lit(":"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    return F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi")).when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("arxiv:"), F.regexp_replace("arxiv_id", "v[0-9]+$", ""))).otherwise(title)


def dedupe_works(works: DataFrame) -> DataFrame:
    """One row a work: records with one key, or one title and year as a keyed record, become one; the richest value of a field
    (longest title and abstract, most citations, else the first record's) stays, sources are united."""
    title = F.concat(T.normal_title(F.col("title")), F.lit(":"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    k = works.withColumn("key", work_key(works)).withColumn("t", title)
    # records that only have a title join the first keyed record of that title
    k = k.withColumn("key", F.when(F.startswith("key", F.lit("title:")), F.coalesce(F.min(F.when(~F.startswith("key", F.lit("title:")), F.struct("work_id", "key"))).over(W.partitionBy("t"))["key"], F.col("key"))).otherwise(F.col("key")))
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("work_id", F.col(c).alias("v"))))["v"].alias(c)
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("work_id"))).alias(c)
    g = k.groupBy("key").agg(F.min("work_id").alias("work_id"), longest("title"), longest("abstract"), *[first(c) for c in ("year", "container", "volume", "issue", "pages", "doi", "url", "publisher", "type", "arxiv_id", "retraction")], F.max("citations").alias("citations"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.drop("key")


def split_name(name: Column) -> Column:
    """struct<family, given>: "Family, Given", or the last word with its particles as family; suffixes fall away."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    parts = F.filter(F.split(n, " "), lambda p: ~F.lower(p).isin("jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "phd", "md"))
    particle = r"((?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]en|[Dd]i|[Dd]a|[Dd]el|[Dd]ella|[Ll]a|[Ll]e|[Bb]in|[Ii]bn|[Aa]l|[Ee]l|[Tt]er|[Tt]en|[Dd]u|[Dd]os|[Dd]as) )*\S+)$"
    whole = F.array_join(parts, " ")
    rest = F.array_join(F.slice(parts, 2, F.size(parts)), " ")
    family = F.when(F.size(parts) <= 1, whole).otherwise(F.regexp_extract(rest, r"(?:^| )" + particle, 1))
    given = F.when(F.size(parts) > 1, F.trim(F.left(whole, F.length(whole) - F.length(family))))
    comma = F.struct(F.trim(F.substring_index(n, ",", 1)).alias("family"), F.trim(F.substring(n, F.instr(n, ",") + 1, F.length(n))).alias("given"))
    return F.when(F.contains(n, F.lit(",")), comma).otherwise(F.struct(family.alias("family"), given.alias("given")))


# formats


def _initial_parts(given: Column, dot: str) -> Column:
    words = F.filter(F.split(F.regexp_replace(given, r"\.", " "), r"\s+"), lambda p: p != "")
    return F.transform(words, lambda p: F.array_join(F.transform(F.filter(F.split(p, "-"), lambda x: x != ""), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lit(dot))), "-"))


def initials(given: Column, apart: str = " ") -> Column:
    return F.array_join(_initial_parts(given, "."), apart)


def _named(a: Column, form) -> Column:
    return F.when(a["organization"] | a["given"].isNull(), a["family"]).otherwise(form(a))


def _join_and(names: Column, word: str, oxford: bool) -> Column:
    head = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    last = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
    return F.when(F.size(names) <= 1, F.array_join(names, "")).when(F.size(names) == 2, F.concat(head, F.lit(f" {word} "), last)).otherwise(F.concat(head, F.lit(("," if oxford else "") + f" {word} "), last))


def _stop(c: Column) -> Column:
    return F.when(c.rlike("[.?!]$"), c).otherwise(F.concat(c, F.lit(".")))


def pages(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*[-–—]\s*", "–")


def _given(before: str, c: Column, after: str = "") -> Column:
    """before c after, or nothing where c is null."""
    return F.coalesce(F.concat(F.lit(before), c.cast("string"), F.lit(after)), F.lit(""))


STYLES = ("apa", "mla", "ieee", "chicago", "harvard", "vancouver")


def formatted(works: DataFrame, style: str) -> DataFrame:
    """work_id, text: the reference-list entry in one of STYLES; numbered styles use the column `number`."""
    a = F.col("authors")
    n = F.size(a)
    names = lambda form: F.transform(a, lambda x: _named(x, form))
    family_i = names(lambda x: F.concat(x["family"], F.lit(", "), initials(x["given"])))
    family_c = names(lambda x: F.concat(x["family"], F.lit(", "), initials(x["given"], "")))
    given = names(lambda x: F.concat(x["given"], F.lit(" "), x["family"]))
    initial = names(lambda x: F.concat(initials(x["given"]), F.lit(" "), x["family"]))
    full = names(lambda x: F.concat(x["family"], F.lit(", "), x["given"]))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    second = lambda c: F.coalesce(F.try_element_at(c, F.lit(2)), F.lit(""))
    book = (F.coalesce(F.col("type"), F.lit("")) == "book") | (F.col("container").isNull() & F.col("publisher").isNotNull() & (F.coalesce(F.col("type"), F.lit("")) != "journal-article"))
    title = F.regexp_replace("title", r"\.+$", "")
    year, vol, iss, pp, con, pub, doi_, url = (F.col(c) for c in ("year", "volume", "issue", "pages", "container", "publisher", "doi", "url"))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), doi_), url)
    put = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    named = lambda who, after=" ": F.when(n > 0, F.concat(who, F.lit(after))).otherwise("")
    inside = lambda c: F.when(con.isNotNull(), c).otherwise("")
    if style == "apa":
        who = F.when(n == 1, first(family_i)).when(n <= 20, F.concat(F.array_join(F.slice(family_i, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.coalesce(F.try_element_at(family_i, F.lit(-1)), F.lit("")))).otherwise(F.concat(F.array_join(F.slice(family_i, 1, 19), ", "), F.lit(", . . . "), F.element_at(family_i, -1)))
        paper = put(title, ". ", inside(put(con, _given(", ", vol), _given("(", iss, ")"), _given(", ", pages(pp)), ". ")))
        out = put(named(_stop(who)), F.when(year.isNotNull(), put("(", year.cast("string"), "). ")).otherwise("(n.d.). "), F.when(book, put(title, ". ", F.coalesce(F.concat(_stop(pub), F.lit(" ")), F.lit("")))).otherwise(paper), F.coalesce(link, F.lit("")))
    elif style == "mla":
        who = F.when(n == 1, first(full)).when(n == 2, put(first(full), ", and ", second(given))).otherwise(put(first(full), ", et al"))
        bits = F.array_compact(F.array(put("vol. ", vol), put("no. ", iss), year.cast("string"), put("pp. ", pages(pp))))
        paper = put("“", title, ".” ", F.when(con.isNotNull(), put(con, F.when(F.size(bits) > 0, put(", ", F.array_join(bits, ", "))).otherwise(""), ". ")).otherwise(_given("", year, ". ")))
        out = put(named(_stop(who)), F.when(book, put(title, ". ", _given("", pub, ", "), _given("", year, "."))).otherwise(paper), _given("", link, "."))
    elif style == "ieee":
        who = F.when(n > 6, put(first(initial), " et al.")).otherwise(_join_and(initial, "and", True))
        doi_part = F.coalesce(put(", doi: ", doi_, "."), F.lit("."))
        art = F.when(pp.rlike("[-–—]"), "pp.").otherwise("Art.")
        paper = put("“", title, ",” ", F.when(con.isNotNull(), put(con, _given(", vol. ", vol), _given(", no. ", iss), F.coalesce(put(", ", art, " ", pages(pp)), F.lit("")), _given(", ", year))).otherwise(_given("", year)), doi_part)
        out = put(_given("[", F.col("number"), "] "), named(who, ", "), F.when(book, put(title, ". ", _given("", pub, ", "), _given("", year, "."))).otherwise(paper))
    elif style == "chicago":
        mixed = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == 1, first(full)).otherwise(F.coalesce(F.try_element_at(given, i), F.lit(""))))
        who = F.when(n > 10, F.array_join(F.array_append(F.slice(mixed, 1, 7), F.lit("et al.")), ", ")).when(n == 2, put(first(full), ", and ", second(given))).otherwise(_join_and(mixed, "and", True))
        paper = put("“", title, ".” ", inside(put(con, _given(" ", vol), _given(" (", iss, ")"), _given(": ", pages(pp)), ". ")))
        out = put(named(_stop(who)), F.coalesce(put(year.cast("string"), ". "), F.lit("n.d. ")), F.when(book, put(title, ". ", F.coalesce(F.concat(_stop(pub), F.lit(" ")), F.lit("")))).otherwise(paper), _given("", link, "."))
    elif style == "harvard":
        who = F.when(n > 3, put(first(family_c), " et al.")).otherwise(_join_and(family_c, "and", False))
        paper = put("‘", title, "’", inside(put(", ", con, _given(", ", vol), _given("(", iss, ")"), _given(", pp. ", pages(pp)))), ". ")
        out = put(named(who), F.coalesce(put("(", year.cast("string"), ") "), F.lit("(no date) ")), F.when(book, put(title, ". ", F.coalesce(F.concat(_stop(pub), F.lit(" ")), F.lit("")))).otherwise(paper), F.coalesce(put("doi: ", doi_, "."), put("Available at: ", url, "."), F.lit("")))
    elif style == "vancouver":
        compact = names(lambda x: F.concat(x["family"], F.lit(" "), F.regexp_replace(F.array_join(_initial_parts(x["given"], ""), ""), "-", "")))
        who = F.when(n > 6, put(F.array_join(F.slice(compact, 1, 6), ", "), ", et al")).otherwise(F.array_join(compact, ", "))
        tail = put(_given("", year), _given(";", vol), _given("(", iss, ")"), _given(":", F.replace(pages(pp), F.lit("–"), F.lit("-"))))
        paper = put(_given("", con, ". "), F.when(tail != "", put(tail, ".")).otherwise(""))
        out = put(_given("", F.col("number"), ". "), named(who, ". "), _stop(F.col("title")), " ", F.when(book, put(_given("", pub, "; "), _given("", year, "."))).otherwise(paper), _given(" doi:", doi_))
    else:
        raise ValueError(f"unknown style {style}")
    return works.select("work_id", F.rtrim(out).alias("text"))


def formatted_in_text(works: DataFrame, style: str) -> DataFrame:
    """work_id, text: what to put into the manuscript."""
    a, n = F.col("authors"), F.size("authors")
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    f = lambda i: F.coalesce(F.try_element_at(a, F.lit(i))["family"], F.lit("Anon."))
    put = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = F.coalesce(F.col("number").cast("string"), F.lit("1"))
    if style == "ieee":
        out = put("[", number, "]")
    elif style == "vancouver":
        out = put("(", number, ")")
    elif style == "mla":
        out = F.when(n == 0, put('("', F.left("title", F.lit(30)), '")')).when(n == 1, put("(", f(1), ")")).when(n == 2, put("(", f(1), " and ", f(2), ")")).otherwise(put("(", f(1), " et al.)"))
    elif style == "chicago":
        out = F.when(n == 0, put("(", year, ")")).when(n == 1, put("(", f(1), " ", year, ")")).when(n == 2, put("(", f(1), " and ", f(2), " ", year, ")")).when(n == 3, put("(", f(1), ", ", f(2), ", and ", f(3), " ", year, ")")).otherwise(put("(", f(1), " et al. ", year, ")"))
    elif style == "harvard":
        out = F.when(n == 0, put("(", year, ")")).when(n == 1, put("(", f(1), ", ", year, ")")).when(n == 2, put("(", f(1), " and ", f(2), ", ", year, ")")).when(n == 3, put("(", f(1), ", ", f(2), " and ", f(3), ", ", year, ")")).otherwise(put("(", f(1), " et al., ", year, ")"))
    else:
        out = F.when(n == 0, put("(", F.array_join(F.slice(F.split("title", " "), 1, 3), " "), ", ", year, ")")).when(n == 1, put("(", f(1), ", ", year, ")")).when(n == 2, put("(", f(1), " & ", f(2), ", ", year, ")")).otherwise(put("(", f(1), " et al., ", year, ")"))
    return works.select("work_id", out.alias("text"))


def _ascii(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, T.MARKED, T.BARE), "[^A-Za-z0-9]", "")


def bibtex_key() -> Column:
    family = F.lower(_ascii(F.coalesce(F.try_element_at(F.col("authors"), F.lit(1))["family"], F.lit("anon"))))
    words = F.filter(F.transform(F.split("title", r"\s+"), lambda w: F.lower(_ascii(w))), lambda w: (F.length(w) > 3) & ~w.isin("with", "from", "that", "this", "using", "their", "which", "toward", "towards"))
    return F.concat(F.when(family == "", "anon").otherwise(family), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))


def bibtex(works: DataFrame) -> DataFrame:
    """work_id, text."""
    safe = lambda c: F.regexp_replace(c, "([&%$#_])", r"\\$1")
    kind = F.when(F.col("type") == "book", "book").when(F.col("type") == "proceedings-article", "inproceedings").when(F.col("container").isNotNull(), "article").otherwise("misc")
    who = F.array_join(F.transform("authors", lambda a: F.when(a["organization"] | a["given"].isNull(), F.concat(F.lit("{"), a["family"], F.lit("}"))).otherwise(F.concat(a["family"], F.lit(", "), a["given"]))), " and ")
    field = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("}"))
    place = F.when(kind == "inproceedings", field("booktitle", safe(F.col("container")))).otherwise(field("journal", safe(F.col("container"))))
    rows = [
        F.when(who != "", field("author", safe(who))), field("title", F.concat(F.lit("{"), safe(F.col("title")), F.lit("}"))), place, field("year", F.col("year").cast("string")), field("volume", safe(F.col("volume"))), field("number", safe(F.col("issue"))),
        field("pages", F.replace(pages(F.col("pages")), F.lit("–"), F.lit("--"))), field("publisher", safe(F.col("publisher"))), field("doi", safe(F.col("doi"))), F.when(F.col("doi").isNull(), field("url", safe(F.col("url")))), field("eprint", safe(F.col("arxiv_id"))),
        F.when(F.col("arxiv_id").isNotNull(), field("archivePrefix", F.lit("arXiv"))),
    ]
    return works.select("work_id", F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(), F.lit(",\n"), F.array_join(F.array_compact(F.array(*rows)), ",\n"), F.lit("\n}")).alias("text"))


def ris(works: DataFrame) -> DataFrame:
    """work_id, text."""
    kind = F.when(F.col("type") == "book", "BOOK").when(F.col("type") == "proceedings-article", "CONF").when(F.col("container").isNotNull(), "JOUR").otherwise("GEN")
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c)
    who = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), _named(a, lambda x: F.concat(x["family"], F.lit(", "), x["given"]))))
    cut = F.split(pages(F.col("pages")), "–")
    tail = [F.when(kind == "CONF", line("T2", F.col("container"))).otherwise(line("JO", F.col("container"))), line("PY", F.col("year").cast("string")), line("VL", F.col("volume")), line("IS", F.col("issue")), line("SP", cut[0]), line("EP", F.try_element_at(cut, F.lit(2))), line("PB", F.col("publisher")), line("DO", F.col("doi")), line("UR", F.col("url"))]
    return works.select("work_id", F.array_join(F.concat(F.array(line("TY", kind)), who, F.array(line("TI", F.col("title"))), F.array_compact(F.array(*tail)), F.array(F.lit("ER  - "))), "\n").alias("text"))


def to_sources(works: DataFrame) -> DataFrame:
    """source_id, title, text, authors, year, url: works as documents to compare with."""
    names = F.transform("authors", lambda a: a["family"])
    who = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, " et al.").otherwise(""))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), "url")
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), "url", F.concat(F.lit("title:"), F.lower("title")))
    return works.select(key.alias("source_id"), "title", F.concat_ws(". ", "title", "abstract").alias("text"), F.when(who != "", who).alias("authors"), "year", link.alias("url"))
