"""Records of bibliographic services brought to one shape of work: four JSON shapes by VARIANT paths, one feed of XML entries.

A work has title, authors array<struct<family,given,organization>>, year, container, volume, issue, pages, doi, url, publisher,
type, arxiv_id, citations, abstract, retraction, source: what matching, ranking and formats take (operators.citations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import let
from inkwell.operators import citations as C
from inkwell.sources.markup import decode_entities

AUTHOR = "struct<family:string,given:string,organization:boolean>"
FIELDS = ("title", "authors", "year", "container", "volume", "issue", "pages", "doi", "url", "publisher", "type", "arxiv_id", "citations", "abstract", "retraction", "source")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"${path}" if path.startswith("[") else f"$.{path}", kind)


def _stripped(text: Column) -> Column:
    """Without tags and entities, single blanks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(decode_entities(F.regexp_replace(text, "<[^>]+>", " ")), r"\s+", " ")), F.lit(""))


def _person(family: Column, given: Column, organization: Column) -> Column:
    return F.struct(family.alias("family"), given.alias("given"), organization.alias("organization")).cast(AUTHOR)


def _named(names: Column) -> Column:
    return F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: let(C.split_name(n), lambda p: _person(p["family"], p["given"], F.lit(False))))


def _parts(family: Column, given: Column, name: Column) -> Column:
    """Authors of records that keep family and given names apart; others are organizations."""
    out = F.transform(F.arrays_zip(family.alias("f"), given.alias("g"), name.alias("n")), lambda a: F.when(a["f"] != "", _person(a["f"], F.nullif(a["g"], F.lit("")), F.lit(False))).otherwise(_person(F.coalesce(a["n"], F.lit("")), F.lit(None).cast("string"), F.lit(True))))
    return F.filter(out, lambda a: a["family"] != "")


def _all(v: Column, path: str, fields: tuple[str, ...]) -> list[Column]:
    """A list's objects as one array a field, nulls where an object has none."""
    kind = f"array<struct<{','.join(f'`{f}`:string' for f in fields)}>>"
    rows = F.coalesce(_get(v, path, kind), F.array().cast(kind))
    return [_field(rows, f) for f in fields]


def _field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def _work(**columns: Column) -> Column:
    kinds = {"authors": f"array<{AUTHOR}>", "year": "int", "citations": "int"}
    return F.struct(*[columns.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS])


UNTITLED = "(untitled)"


def from_crossref(v: Column) -> Column:
    f, g, n = _all(v, "author", ("family", "given", "name"))
    year = lambda k: _get(v, f"['{k}']['date-parts'][0][0]" if "-" in k else f"{k}['date-parts'][0][0]", "int")
    updates = F.coalesce(_get(v, "['updated-by']", "array<struct<type:string>>"), F.array().cast("array<struct<type:string>>"))
    relations = F.coalesce(F.map_keys(_get(v, "relation", "map<string,variant>")), F.array().cast("array<string>"))
    title = _get(v, "title[0]")
    return _work(
        title=F.coalesce(_stripped(title), F.lit(UNTITLED)), authors=_parts(f, g, n), year=F.coalesce(*[year(k) for k in ("issued", "published-print", "published-online", "created")]),
        container=_stripped(_get(v, "['container-title'][0]")), volume=_get(v, "volume"), issue=_get(v, "issue"), pages=_get(v, "page"), doi=C.doi(_get(v, "DOI")), url=_get(v, "URL"), publisher=_get(v, "publisher"), type=_get(v, "type"),
        abstract=_stripped(_get(v, "abstract")), citations=_get(v, "['is-referenced-by-count']", "int"), retraction=C.retraction(F.coalesce(title, F.lit("")), _field(updates, "type"), relations), source=F.lit("crossref"),
    )


def from_openalex(v: Column) -> Column:
    names = _get(v, "authorships", "array<struct<author:struct<display_name:string>>>")
    names = F.transform(F.coalesce(names, F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: a["author"]["display_name"])
    first, last = _get(v, "biblio.first_page"), _get(v, "biblio.last_page")
    index = _get(v, "abstract_inverted_index", "map<string,array<int>>")
    placed = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    kind = _get(v, "type")
    return _work(
        title=F.coalesce(F.nullif(F.trim(F.coalesce(_get(v, "title"), _get(v, "display_name"))), F.lit("")), F.lit(UNTITLED)), authors=_named(names), year=_get(v, "publication_year", "int"), container=_get(v, "primary_location.source.display_name"), volume=_get(v, "biblio.volume"), issue=_get(v, "biblio.issue"),
        pages=F.when(last != first, F.concat(first, F.lit("-"), last)).otherwise(first), doi=C.doi(_get(v, "doi")), url=F.coalesce(_get(v, "primary_location.landing_page_url"), _get(v, "id")), type=F.when(kind == "article", "journal-article").otherwise(kind),
        abstract=F.nullif(F.array_join(F.transform(placed, lambda x: x["w"]), " "), F.lit("")), citations=_get(v, "cited_by_count", "int"), retraction=F.when(_get(v, "is_retracted", "boolean"), "retracted"), source=F.lit("openalex"),
    )


def from_datacite(v: Column) -> Column:
    a = "data.attributes"
    f, g, n = _all(v, f"{a}.creators", ("familyName", "givenName", "name"))
    kind = "array<struct<descriptionType:string,description:string>>"
    said = F.filter(F.coalesce(_get(v, f"{a}.descriptions", kind), F.array().cast(kind)), lambda d: d["descriptionType"] == "Abstract")
    return _work(
        title=F.coalesce(F.nullif(F.trim(_get(v, f"{a}.titles[0].title")), F.lit("")), F.lit(UNTITLED)), authors=_parts(f, g, n), year=_get(v, f"{a}.publicationYear", "int"), publisher=F.coalesce(_get(v, f"{a}.publisher.name"), _get(v, f"{a}.publisher")),
        doi=C.doi(_get(v, f"{a}.doi")), url=_get(v, f"{a}.url"), type=F.lower(_get(v, f"{a}.types.resourceTypeGeneral")), abstract=F.try_element_at(said, F.lit(1))["description"], source=F.lit("datacite"),
    )


def from_scholar(v: Column) -> Column:
    kind = "array<struct<name:string>>"
    names, kind_ = _field(F.coalesce(_get(v, "authors", kind), F.array().cast(kind)), "name"), _get(v, "publicationTypes[0]")
    return _work(
        title=F.coalesce(F.nullif(F.trim(_get(v, "title")), F.lit("")), F.lit(UNTITLED)), authors=_named(names), year=_get(v, "year", "int"), container=F.coalesce(F.nullif(_get(v, "journal.name"), F.lit("")), F.nullif(_get(v, "venue"), F.lit(""))), volume=F.trim(_get(v, "journal.volume")), pages=F.trim(_get(v, "journal.pages")),
        doi=C.doi(_get(v, "externalIds.DOI")), arxiv_id=_get(v, "externalIds.ArXiv"), url=_get(v, "url"), citations=_get(v, "citationCount", "int"), abstract=_get(v, "abstract"), type=F.when(kind_ == "JournalArticle", "journal-article").when(kind_ == "Conference", "proceedings-article").otherwise(F.lower(kind_)), source=F.lit("semanticscholar"),
    )


def from_feed(entry: Column) -> Column:
    """One <entry> of an Atom feed of preprints."""
    tag = lambda name: F.nullif(F.trim(F.regexp_replace(decode_entities(F.regexp_extract(entry, f"(?is)<{name}[^>]*>(.*?)</{name}>", 1)), r"\s+", " ")), F.lit(""))
    names = F.transform(F.regexp_extract_all(entry, F.lit(r"(?is)<author>\s*<name>(.*?)</name>"), F.lit(1)), decode_entities)
    found = F.nullif(F.regexp_extract(tag("id"), r"abs/(.+)$", 1), F.lit(""))
    return _work(
        title=tag("title"), authors=_named(names), year=F.nullif(F.regexp_extract(tag("published"), "^([0-9]{4})", 1), F.lit("")), arxiv_id=F.regexp_replace(found, "v[0-9]+$", ""), url=F.concat(F.lit("https://arxiv.org/abs/"), found), abstract=tag("summary"),
        doi=C.doi(tag("arxiv:doi")), container=tag("arxiv:journal_ref"), type=F.lit("preprint"), source=F.lit("arxiv"),
    )


SHAPES = {"crossref": from_crossref, "openalex": from_openalex, "datacite": from_datacite, "semanticscholar": from_scholar}


def works(records: DataFrame) -> DataFrame:
    """work_id and a work's fields of records (work_id, service, body). JSON that can't be parsed and unknown services give no row."""
    v = records.withColumn("v", F.try_parse_json("body"))
    w = F.when(F.col("service") == "arxiv", from_feed(F.col("body")))
    for name, shape in SHAPES.items():
        w = w.when((F.col("service") == name) & F.col("v").isNotNull(), shape(F.col("v")))
    return v.select("work_id", F.inline(F.array(w))).where("title is not null")  # inline: each record is read once, not once a field
