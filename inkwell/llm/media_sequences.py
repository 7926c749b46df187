"""Operator 10: media columns as interleaved document sequences.

HTML is parsed into ordered elements: text pieces and media references (digest, caption, declared bytes). A content-addressed
media table holds each payload as an 8-bit greyscale PNG, 192 samples a line. References resolve to payloads by a join on
the digest, and sequences are put together again by position, so captions stay beside their media.

Media tables are written to the shared folder by Spark; features are computed from the bytes read back. Features are small
rows, made unique by digest before the join (which needs no further shuffle of them), so copies of one payload, however many,
don't gather payloads anywhere; references to payloads that many pages show stay where they are.

Defined cases: null html has no elements; a reference that no payload matches keeps its place with null media; null text is
empty (its payload is one line of blanks); repeated rows each get a row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.tables import stored, table

LINE = 192
SCHEME = "media:"
SKIPPED = frozenset({"script", "style", "nav", "template", "noscript", "head"})
BROKEN_BY = frozenset({"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "article", "section", "figure", "figcaption", "body", "footer", "header", "blockquote", "pre"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Tags of a body: where one of them starts, a head has ended.
BODY = BROKEN_BY | {"img", "video", "audio", "a", "span", "b", "i", "em", "strong", "main", "nav", "form", "input", "aside"}
#: Digests with more references meet their features in a broadcast, as long as they are no more than HOT_DIGESTS rows (some 20 MB).
HOT_REFERENCES, HOT_DIGESTS = 1_000, 50_000


class _Elements(HTMLParser):
    """Collects (kind, text, digest, caption, n_bytes) in document order.

    Open elements are kept on a stack: an end tag closes all that was opened after its start tag, so lost end tags hide nothing
    past their parent. A head ends where the body or anything of a body begins, a nav where main or an article begins. A caption
    belongs to the media of its own figure; outside a figure it is text, as is one that never ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.skip = 0
        self.figures: list[dict] = []  # first: index of its first element; caption: its text; depth: of the open caption

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(["text", text, None, None, None])

    def _caption(self) -> bool:
        return bool(self.figures) and self.figures[-1]["depth"] is not None

    def _close(self, depth: int, ended: bool = True) -> None:
        """Closes all open elements from depth on."""
        while len(self.open) > depth:
            tag = self.open.pop()
            if tag in SKIPPED:
                self.skip -= 1
            if self.skip:
                continue
            figure = self.figures[-1] if self.figures else None
            if tag == "figcaption" and figure and figure["depth"] == len(self.open):
                figure["depth"] = None
                if ended:
                    figure["caption"] = " ".join("".join(self.text).split())
                    self.text = []
            if tag in BROKEN_BY and not self._caption():
                self.flush()
            if tag == "figure" and self.figures:
                figure = self.figures.pop()
                for x in self.out[figure["first"] :]:
                    if x[0] == "media" and len(x) == 5:
                        x[3] = figure["caption"] or x[3]
                        x.append(True)  # an outer figure's caption is not this one's

    def handle_starttag(self, tag, attrs):
        if "head" in self.open and tag in BODY:
            self._close(self.open.index("head"))
        if "nav" in self.open and tag in ("main", "article"):
            self._close(self.open.index("nav"))
        if tag not in VOID:
            self.open.append(tag)
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BROKEN_BY and not self._caption():
            self.flush()
        if tag == "figure":
            self.figures.append({"first": len(self.out), "caption": None, "depth": None})
        elif tag == "figcaption" and self.figures and not self._caption():
            self.figures[-1]["depth"] = len(self.open) - 1
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            source = a.get("src") or a.get("data-src")
            if source:
                if not self._caption():
                    self.flush()
                size = a.get("data-bytes") or ""
                self.out.append(["media", None, source.removeprefix(SCHEME), a.get("alt") or None, int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None])

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, [])
        elif tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def finish(self) -> list[list]:
        self.close()
        self._close(0, ended=False)
        self.flush()
        return [x[:5] for x in self.out]


def elements(page: str | None) -> list[list]:
    parser = _Elements()
    parser.feed(page or "")
    return parser.finish()


SEQUENCE = ("position int", "kind string", "text string", "digest string", "caption string", "n_bytes long")


def parse_sequences(pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """pages(keys, html), keys whole numbers -> one row an element, in reading order by position."""
    names = [*keys, *(x.split()[0] for x in SEQUENCE)]
    types = [*[pa.int64()] * len(keys), pa.int32(), *[pa.string()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                cols = [c.to_pylist() for c in b.slice(i, 1000).columns]
                rows = [(*k, n, *e) for *k, h in zip(*cols, strict=True) for n, e in enumerate(elements(h))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return pages.select(*[F.col(k).cast("long").alias(k) for k in keys], "html").mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), *SEQUENCE]))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Adds media's columns (unique by digest) to the references; text keeps its place with nulls."""
    texts = sequences.where("kind = 'text'")
    return sequences.where("kind = 'media'").join(media, "digest", "left").unionByName(texts, allowMissingColumns=True)


def interleave(resolved: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, sequence: the elements of a page as an array of structs in order."""
    rest = [c for c in resolved.columns if c not in (*keys, "position")]
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("sequence"))


def to_png(payload: bytes) -> bytes:
    """Losslessly: 8-bit greyscale, LINE samples a line, no line filter."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    at, data = 8, []
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, LINE + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, shares of 16 brightness steps (per mille) and 64 bits: which of 64 equal parts are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    steps = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.r_[np.arange(64) * len(x) // 64, len(x)])
    bits = np.packbits(parts > x.mean()).tobytes().hex()
    return f"{x.mean():.3f}|{x.std():.3f}|{','.join(map(str, steps))}|{bits}"


def padded(text: bytes) -> bytes:
    return text + b" " * (max(LINE, -(-len(text) // LINE) * LINE) - len(text))


def document_media(docs: DataFrame) -> DataFrame:
    """Stores, for (doc_id, text): row (its number), page_id (doc_id), html (a page whose figure shows the text's bytes), digest
    and stored (its PNG; null where the same task has it already). Read html for pages, digest and stored for the media table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows = []
                for number, k, text in zip(*(b.column(c).slice(i, 500).to_pylist() for c in range(3)), strict=True):
                    raw = (text or "").encode()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload)
                    png = None
                    if digest.digest() not in seen:
                        if len(seen) < 200_000:
                            seen.add(digest.digest())
                        png = to_png(payload)
                    page = f'<article><h1>Document {k}</h1><figure><img src="{SCHEME}{digest.hexdigest()}" data-bytes="{len(raw)}"><figcaption>{html_.escape(f"Text of document {k}")}</figcaption></figure></article>'
                    rows.append((number, k, page, digest.hexdigest(), png))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["row", "page_id", "html", "digest", "stored"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("page_id"), "text")
    return stored(rows.mapInArrow(run, "row long, page_id long, html string, digest string, stored binary"), "media")


MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """media(digest, stored) -> features of the payloads read back, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows = []
                for d, s in zip(b.column(0).slice(i, 500).to_pylist(), b.column(1).slice(i, 500).to_pylist(), strict=True):
                    p = from_png(s)
                    rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature(p)))
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in MEDIA.split(", ")])

    return media.select("digest", "stored").where("stored is not null").mapInArrow(run, MEDIA).dropDuplicates(["digest"])


def document_sequences(held: DataFrame, hot_references: int = HOT_REFERENCES, hot_digests: int = HOT_DIGESTS) -> DataFrame:
    """row, page_id, sequence for a table of `document_media`: pages parsed, payloads read back and joined by digest.

    References to a payload that many pages show don't move: its features are broadcast."""
    keys = ("row", "page_id")
    crowded = stored(held.groupBy("digest").count().where(F.col("count") > hot_references).select("digest"), "media-hot")
    many = crowded.count()
    if not 0 < many <= hot_digests:
        return interleave(resolve(parse_sequences(held, keys), media_features(held)), keys)
    hot, rest = (held.join(F.broadcast(crowded), "digest", how) for how in ("left_semi", "left_anti"))
    parts = [resolve(parse_sequences(hot, keys), F.broadcast(media_features(hot))), resolve(parse_sequences(rest, keys), media_features(rest))]
    return interleave(parts[0].unionByName(parts[1]), keys)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_sequences(document_media(table(spark, sf_dir, "documents")))
    one = lambda kind: F.try_element_at(F.filter("sequence", lambda x: x["kind"] == kind), F.lit(1))
    pages = pages.select(F.col("page_id").alias("doc_id"), one("media").alias("m"), one("text").alias("t"), F.size("sequence").alias("elements"))
    named = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
    return pages.select("doc_id", *[F.col(f"m.{x}").alias(x) for x in named], F.col("t.text").alias("heading"), "elements")


QUERIES = {"op10_media_sequences": op10}
ORACLES: dict = {}
