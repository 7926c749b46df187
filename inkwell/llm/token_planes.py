"""Operator 8: token ids in a bit-plane-shuffled binary format.

Texts are encoded, documents sorted by doc_id and packed into shards. A shard is one self-contained binary value:

    magic "PLN1", then six little-endian uint32: ids a block, blocks, documents, id bytes, ids, bytes of the chunk index;
    the chunk index, for each block: ids in it, then offset and length of each of its planes (uint32);
    the documents' id counts (uint32 each);
    the planes: byte k of every id of a block, bit-transposed (8 bit planes of the byte, each packed), zstandard-compressed.

A shard closes when it holds `shard_ids` ids; a longer document gets a shard of its own. Shards are rows of a Parquet table
in the shared folder (part, shard, first_doc ..., payload), so Spark's commit protocol covers lost executors and any store
works. Rows sort by range into parts of `part_bytes` bytes of text, as many as the data needs; starts come from sums over parts,
then over a part's shards. (To encode first and sort ids instead of texts takes a table more; see the README for figures.)

The tokenizer sees each distinct blank-separated word of a batch once: its normaliser and splitter never look across blanks
(white space is dropped, patterns contain none), so ids of words in a row are the ids of the text.

Defined cases: null text is empty (the end id alone); null doc_id sorts first; repeated doc_ids sort by a hash of the text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import SPACE, slices, word_hashes, words
from inkwell.tables import stored, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
PART_BYTES = 1 << 24
TABLE_BITS = 21
CACHE_WORDS = 1_000_000
#: Bytes of text at once; larger slices repeat more words.
SLICE = 1 << 21
MAGIC = b"PLN1"
MARK = "\x01"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes text columns word by word. Words that were seen are found by 64-bit hashes in a table of 2^TABLE_BITS places,
    the first to come keeps a place; frequent words come early. So memory is bounded whatever the texts."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or vocabulary_path())
        # words go to the tokenizer in groups, parted by a control character between blanks, which has an id of its own
        self.mark_id = self.model.encode(MARK, add_special_tokens=False).ids[-1]
        self.hash = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot = np.zeros(1 << TABLE_BITS, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.int64)

    def fresh(self, new: list[str], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words one after another, and how many each has."""
        odd = [k for k, t in enumerate(new) if MARK in t]
        plain = [t if MARK not in t else "" for t in new] if odd else new
        groups = [f" {MARK} ".join(plain[i : i + group]) + f" {MARK}" for i in range(0, len(plain), group)]
        got = [x for e in self.model.encode_batch_fast(groups, add_special_tokens=False) for x in e.ids]
        ids = np.array(got, np.uint32)
        cut = np.flatnonzero(ids == self.mark_id)
        count = np.diff(cut, prepend=-1) - 1
        ids = ids[ids != self.mark_id]
        if len(count) != len(new):
            raise ValueError("this vocabulary gives the mark no id of its own")
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in odd:
                parts[k] = np.array(self.model.encode(new[k], add_special_tokens=False).ids, np.uint32)
                count[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, count

    def words_ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): the ids of word k of a binary array are ids[first[k] : first[k] + count[k]]."""
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)[at[0] : at[-1]]
        h = word_hashes(data, at[:-1] - at[0], at[1:] - at[0]) | np.uint64(1)  # zero is an empty place
        place = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slot = np.where(self.hash[place] == h, self.slot[place], -1).astype(np.int64)
        where = np.flatnonzero(slot < 0)
        flat, count = self.flat, self.count
        if len(where):
            ids, n = self.fresh(distinct.take(pa.array(where)).cast(pa.large_string()).to_pylist())
            slot[where] = len(count) + np.arange(len(where))
            flat, count = np.concatenate([flat, ids]), np.concatenate([count, n])
            free = where[self.hash[place[where]] == 0]
            free = free[np.unique(place[free], return_index=True)[1]]
            if len(free) and len(count) < CACHE_WORDS:
                self.flat, self.count = flat, count
                self.hash[place[free]], self.slot[place[free]] = h[free], slot[free]
        first = np.cumsum(count) - count
        return flat, first[slot], count[slot]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids of these rows, ids in each row)."""
        for i, j, data, at in slices(texts, SLICE):
            start, end, row = words(data, at)
            n = j - i
            if not len(start):
                yield i, j, np.zeros(0, np.uint32), np.zeros(n, np.int64)
                continue
            # the words as an Arrow column: gather their bytes
            size = end - start
            offsets = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=offsets[1:])
            col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])])
            coded = col.dictionary_encode()
            flat, first, count = self.words_ids(coded.dictionary)
            which = coded.indices.to_numpy()
            each = count[which]
            upto = np.cumsum(each)
            out = flat[np.repeat(first[which] - (upto - each), each) + np.arange(upto[-1])]
            yield i, j, out, np.bincount(row, weights=each, minlength=n).astype(np.int64)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python worker: tasks that follow find its words."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each followed by end_id."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def pack(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK_IDS, level: int = 1) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    index, planes, at = [], [], 0
    for i in range(0, len(ids), block):
        part = ids[i : i + block].astype("<u4")
        index.append(struct.pack("<I", len(part)))
        of_byte = part.view(np.uint8).reshape(-1, 4)
        for k in range(width):
            byte = np.ascontiguousarray(of_byte[:, k])
            done = press.compress(b"".join(np.packbits((byte & (128 >> bit)) != 0).tobytes() for bit in range(8)))
            index.append(struct.pack("<II", at, len(done)))
            planes.append(done)
            at += len(done)
    head = b"".join(index)
    return MAGIC + struct.pack("<6I", block, -(-len(ids) // block), len(counts), width, len(ids), len(head)) + head + counts.astype("<u4").tobytes() + b"".join(planes)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document)."""
    import zstandard

    if payload[:4] != MAGIC:
        raise ValueError("not a plane-shuffled shard")
    block, blocks, docs, width, total, size = struct.unpack_from("<6I", payload, 4)
    body = 28 + size + 4 * docs
    ids, done, entry = np.zeros(total, np.uint32), 0, 4 + 8 * width
    open_ = zstandard.ZstdDecompressor()
    for b in range(blocks):
        n = struct.unpack_from("<I", payload, 28 + b * entry)[0]
        of_byte = np.zeros((n, 4), np.uint8)
        for k in range(width):
            at, length = struct.unpack_from("<II", payload, 28 + b * entry + 4 + 8 * k)
            planes = np.frombuffer(open_.decompress(payload[body + at : body + at + length]), np.uint8).reshape(8, -1)
            byte = np.zeros(n, np.uint8)
            for bit in range(8):
                byte |= np.unpackbits(planes[bit], count=n) << np.uint8(7 - bit)
            of_byte[:, k] = byte
        ids[done : done + n] = of_byte.reshape(-1).view("<u4")
        done += n
    return ids, np.frombuffer(payload, "<u4", docs, 28 + size).astype(np.int64)


SHARDS = "part int, shard int, docs long, ids long, doc_ids array<bigint>, payload binary"


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block: int = BLOCK_IDS, shard_ids: int = SHARD_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encodes (doc_id, text), sorts by doc_id and stores the shards; returns the stored table.

    Rows of one doc_id, however many, may be parted between tasks: they are told apart by a hash of the text and their place in
    the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, shard = TaskContext.get().partitionId(), encoder(path), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, shard
            counts = np.concatenate([c for _, c, _ in held])
            keys = [k for _, _, ks in held for k in ks]
            ids = np.concatenate([x for x, _, _ in held])
            row = [[part], [shard], [len(counts)], [len(ids)], [keys], [pack(ids, counts, block)]]
            held, size, shard = [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "shard", "docs", "ids", "doc_ids", "payload"])

        for batch in batches:
            keys = batch.column(0)
            for i, j, ids, counts in coder.column(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                if held and size + len(ids) > shard_ids:
                    yield close()
                held.append((ids, counts, keys[i:j].to_pylist()))
                size += len(ids)
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("place"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism if total > part_bytes else 1, -(-total // part_bytes))
    sorted_ = rows.repartitionByRange(parts, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return stored(sorted_.mapInArrow(run, SHARDS), "planes")


def starts(shards: DataFrame) -> DataFrame:
    """part, shard and the ids that all earlier shards hold."""
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    return shards.select("part", "shard", (F.sum("ids").over(inside) - F.col("ids")).alias("inside")).join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the stored payloads (which stay where they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, keys, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids, counts = unpack(payload.as_py())
                stops = np.cumsum(counts)
                begin = stops - counts
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stops.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * n, pa.int32()) for x in (part, shard)] + [keys.values, pa.array(begin), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards.select("part", "shard", "ids")), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))


QUERIES = {"op8_token_planes": op8}
ORACLES: dict = {}
