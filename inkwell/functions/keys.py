"""Keys and small conversions: works, identifiers, dates, queries, network addresses, priors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_work(title: Column) -> Column:
    """Titles that differ only in case, punctuation or a bracketed prefix are one work."""
    t = F.regexp_replace(F.lower(title), r"^\[[^\]]*\]\s*", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def arxiv_id(doi: Column, url: Column) -> Column:
    """An arXiv number without its version, from a DOI or an address; null if there is none."""
    number = r"([0-9]{4}\.[0-9]{4,5})"
    a = F.regexp_extract(F.coalesce(doi, F.lit("")), rf"(?i)10\.48550/arxiv\.{number}", 1)
    b = F.regexp_extract(F.coalesce(url, F.lit("")), rf"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*){number}", 1)
    return F.when(a != "", a).when(b != "", b)


def date_text(parts: Column) -> Column:
    """[2020, 3, 7] -> 2020-03-07; a missing month or day is left out."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0"))), "-")


def clean_phrase(text: Column, most: int = 12) -> Column:
    """A query of words only, single blanks, at most `most` words."""
    w = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}'\-]+", " "), " "), lambda x: x != "")
    return F.array_join(F.slice(w, 1, most), " ")


def citation_prior(citations: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(1 + F.coalesce(citations, F.lit(0))) / 5)


#: Networks that must not be fetched from, as (kind, first address, prefix length).
NETWORKS = (("metadata", "169.254.169.254", 32), ("loopback", "127.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12), ("private", "192.168.0.0", 16), ("link-local", "169.254.0.0", 16), ("shared", "100.64.0.0", 10), ("unspecified", "0.0.0.0", 8), ("multicast", "224.0.0.0", 4), ("reserved", "240.0.0.0", 4))


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def network_kind(address: Column) -> Column:
    """The kind of network of an IPv4 address (also written as ::ffff:a.b.c.d); 'public', or null if it is no address."""
    bare = F.regexp_replace(address, r"(?i)^::ffff:", "")
    p = F.transform(F.split(bare, r"\."), lambda x: x.try_cast("long"))
    good = bare.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(p, lambda x: x <= 255)
    n = F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    kind = F.lit("public")
    for name, first, bits in reversed(NETWORKS):
        kind = F.when(F.shiftright(n, 32 - bits) == _number(first) >> (32 - bits), name).otherwise(kind)
    return F.when(good, kind)
