"""Operator 2: language-model scoring by prediction by partial matching (PPM).

A text is scored as its sequence of words: A-Z lowered, words joined by one blank, one end mark. The model is a trie of byte
contexts up to ORDER bytes with escape method D and symbol exclusion: a context with n occurrences of d distinct bytes gives
each known byte (c - 1/2)/n and escapes with d/(2n) to the context one byte shorter, where bytes that the longer one knows
are left out; below order 0 all unseen bytes are equal. Shorter contexts count updates only where the longer one did not
know the byte, which is the number of distinct longer contexts. Each position's probabilities add up to 1.

Training counts (order + 1)-grams and words in tasks, merges them by partial aggregation and stores the table; lower orders
are sums over it. So what is gathered grows with the corpus and is never cut.

Scoring: trie branches of contexts that end in the same two bytes hold all that such positions need (orders 0 and 1 are
tables of at most 256 and 65,536 rows), so branches are packed into shards of at most `shard_grams` grams, each shard is
broadcast, and each takes the positions that belong to it in a pass over the texts; sums add up. Usually there is one shard.

Word baseline: words with the highest counts (at most TOP_WORDS) are broadcast, all other words of a text go through a join
with the stored counts, so no count is lost. Words are known by 64-bit hashes.

Defined cases: null text is empty (the end mark alone); a null doc_id is learnt from (crc32 of the empty text) and kept;
repeated rows each count and each get a row; without training rows all bytes cost log10(256) and base_score is 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import LOWER, SPACE, mixed, slices, word_hashes, words
from inkwell.llm.toxicity import remainder
from inkwell.tables import stored, table

ORDER = 5
SHARD_GRAMS = 1_500_000
TOP_WORDS = 400_000
END = 10  # no word holds it
END_WORD = -1
GRAM, WORD = 0, 1
FLUSH = 1_500_000
#: Bytes of text at once: a position costs some 60 bytes of arrays.
SLICE = 1 << 18


def sequences(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row and gram of each coded byte, row and hash of each word). A gram is its context's bytes and the byte, packed."""
    low = LOWER[data]
    start, end, row = words(low, at)
    rows = len(at) - 1
    h = word_hashes(low, start, end).view(np.int64)
    size = end - start
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    length = np.bincount(row, size + 1, rows).astype(np.int64)
    empty = length == 0
    length[empty] = 1
    begin = np.cumsum(length + order) - length  # of a row's coded bytes; `order` end marks stand before them
    buf = np.full(begin[-1] + length[-1] if rows else 0, END, np.uint8)
    before = np.cumsum(size + 1) - size - 1
    first = np.searchsorted(row, row, "left") if len(row) else row
    place = begin[row] + before - before[first] if len(row) else before
    buf[np.arange(size.sum()) + np.repeat(place - (np.cumsum(size) - size), size)] = low[~SPACE[low]]
    buf[(place + size)[~last]] = 32
    wide = buf.astype(np.uint64)
    gram = np.zeros(len(buf), np.uint64)
    for k in range(order + 1):
        gram[order:] = (gram[order:] << np.uint64(8)) | wide[k : len(buf) - order + k]
    coded = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
    return np.repeat(np.arange(rows), length), gram[coded], row, h


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind (GRAM or WORD), key, n over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}
        kept = {GRAM: 0, WORD: 0}

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, n = _merged(held[kind])
                for i in range(0, len(keys), 500_000):
                    k = keys[i : i + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[i : i + 500_000])], names=["kind", "key", "n"])
            held[kind], kept[kind] = [], 0

        for b in batches:
            for i, j, data, at in slices(b.column(0), SLICE):
                _, gram, _, h = sequences(data, at, order)
                ends = (np.array([END_WORD], np.int64), np.array([j - i]))
                for kind, part in ((GRAM, [np.unique(gram.view(np.int64), return_counts=True)]), (WORD, [np.unique(h, return_counts=True), ends])):
                    held[kind] += part
                    kept[kind] += len(part[0][0])
                    if kept[kind] > FLUSH:
                        held[kind] = [_merged(held[kind])]
                        kept[kind] = len(held[kind][0][0])
                        if kept[kind] > FLUSH // 2:
                            yield from out(kind)
        for kind in held:
            yield from out(kind)

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """Places of uint64 keys: open addressing, filled and looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(4, int(max(1, len(keys)) * 3).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._first(self.keys)
        while len(left):
            free = self.slots[at] < 0
            who, slot = left[free], at[free]
            slot, one = np.unique(slot, return_index=True)
            self.slots[slot] = who[one]
            stays = self.slots[at] != left
            left, at = left[stays], (at[stays] + 1) & (len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> self.shift).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        at, left = self._first(keys), None
        while True:
            got = self.slots[at]
            here = got >= 0
            same = np.zeros(len(got), bool)
            same[here] = self.keys[got[here]] == (keys if left is None else keys[left])[here]
            if left is None:
                out[same] = got[same]
                left = np.flatnonzero(here & ~same)
                at = (at[left] + 1) & (len(self.slots) - 1)
            else:
                out[left[same]] = got[same]
                go = here & ~same
                left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
            if not len(left):
                return out


class Trie:
    """Costs (log10) of all contexts in a set of grams, for positions whose two bytes before are among theirs."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        """gram, n: (order + 1)-grams; low: all 2-grams of the corpus and their counts, which give orders 1 and 0."""
        self.order = order
        self.entry: list[np.ndarray] = [None] * (order + 1)  # sorted grams of each order
        self.count: list[np.ndarray] = [None] * (order + 1)
        self.node: list[np.ndarray] = [None] * (order + 1)  # sorted contexts
        self.total: list[np.ndarray] = [None] * (order + 1)
        self.kinds: list[np.ndarray] = [None] * (order + 1)
        self.left: list[np.ndarray] = [None] * (order + 1)  # of a context's parent: occurrences of bytes that it doesn't know
        self.fresh: list[np.ndarray] = [None] * (order + 1)  # and how many such bytes
        for j in range(order, -1, -1):
            if j == order or j == 1:
                keys, n = (gram, n) if j == order else low
                rank = np.argsort(keys.astype(np.uint64))
                self.entry[j], self.count[j] = keys.astype(np.uint64)[rank], n.astype(np.float64)[rank]
            else:
                self.entry[j], place = np.unique(self.entry[j + 1] & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
                self.count[j] = np.bincount(place, minlength=len(self.entry[j])).astype(np.float64)
            self.node[j], owner, self.kinds[j] = np.unique(self.entry[j] >> np.uint64(8), return_inverse=True, return_counts=True)
            self.total[j] = np.bincount(owner, self.count[j], len(self.node[j]))
        for j in range(order, 0, -1):
            mask = np.uint64((1 << (8 * j)) - 1)
            known = self.count[j - 1][np.searchsorted(self.entry[j - 1], self.entry[j] & mask)]
            owner = np.searchsorted(self.node[j], self.entry[j] >> np.uint64(8))
            parent = np.searchsorted(self.node[j - 1], self.node[j] & (mask >> np.uint64(8)))
            self.left[j] = self.total[j - 1][parent] - np.bincount(owner, known, len(self.node[j]))
            self.fresh[j] = (self.kinds[j - 1][parent] - self.kinds[j]).astype(np.float64)
        with np.errstate(divide="ignore"):
            owner = np.searchsorted(self.node[order], self.entry[order] >> np.uint64(8))
            self.top_cost = np.log10((self.count[order] - 0.5) / self.total[order][owner])
        self.top = Table(self.entry[order])

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after its context."""
        out = np.zeros(len(gram))
        place = self.top.places(gram)
        out[place >= 0] = self.top_cost[place[place >= 0]]
        rest = np.flatnonzero(place < 0)
        child = np.full(len(rest), -1, np.int64)  # the context just escaped from, one order up
        for j in range(self.order, -1, -1):
            if not len(rest):
                return out
            g = gram[rest] & np.uint64((1 << (8 * (j + 1))) - 1)
            node = _find(self.node[j], g >> np.uint64(8))
            there = node >= 0
            known = child >= 0
            total, kinds = np.zeros(len(rest)), np.zeros(len(rest))
            total[there], kinds[there] = self.total[j][node[there]], self.kinds[j][node[there]]
            if j < self.order and known.any():
                total[known], kinds[known] = self.left[j + 1][child[known]], self.fresh[j + 1][child[known]]
            entry = _find(self.entry[j], g)
            hit = entry >= 0
            all_ = np.maximum(total, 0.5)
            out[rest[hit]] += np.log10((self.count[j][entry[hit]] - 0.5) / all_[hit])
            miss = ~hit
            pays = miss & there & (kinds > 0)
            out[rest[pays]] += np.log10(kinds[pays] / 2 / all_[pays])
            rest, child = rest[miss], np.where(there, node, -1)[miss]
        known = len(self.entry[0])
        out[rest] -= np.log10(max(1, 256 - known))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return np.where(keys[place] == wanted, place, -1)


def shards(grams: DataFrame, most: int) -> list[list[int]]:
    """Two-byte context ends, packed into groups of at most `most` grams (one end alone may have more)."""
    size = grams.groupBy(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("end")).count().collect()  # 65,536 rows at most
    out: list[list[int]] = []
    room = 0
    for end, n in sorted((r["end"], r["count"]) for r in size):
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append(end)
        room -= n
    return out or [[]]


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", "n").toArrow()
    return t["key"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64)


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, shard_grams: int = SHARD_GRAMS, top_words: int = TOP_WORDS) -> DataFrame:
    """docs(doc_id, text), training(text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = stored(counts(training, order).repartition("key"), "ppm-counts")
    grams, known = held.where(F.col("kind") == GRAM), held.where(F.col("kind") == WORD)
    sums = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    steps = known.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()  # 512 rows at most
    taken, least = 0, None
    for r in steps:
        taken += r["count"]
        if taken > top_words:
            break
        least = r["step"]
    frequent = F.lit(False) if least is None else F.floor(F.log2("n") * 8) >= least
    top = _arrays(known.where(frequent))
    two = F.col("key").bitwiseAND(F.lit(0xFFFF))
    low = _arrays(grams.select(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).distinct().groupBy(two.alias("key")).agg(F.count("*").alias("n")))  # 65,536 rows at most
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = shards(grams, shard_grams)
    passes, sent = [], []
    for k, ends in enumerate(groups):
        mine = grams if len(groups) == 1 else grams.where(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)).isin(ends))
        trie = Trie(*_arrays(mine), low, order)
        sent.append(spark.sparkContext.broadcast((trie, None if len(groups) == 1 else np.array(ends), top if k == 0 else None)))
        passes.append(_pass(source, sent[-1], k == 0, len(groups) > 1 and k == 0, [e for g in groups for e in g], order))
    parts = stored(reduce(DataFrame.unionByName, passes), "ppm-scores")
    for b in sent:  # what follows reads the stored scores
        b.unpersist()
    first = parts.where("n_tokens is not null") if len(groups) > 1 else parts
    rare = first.select("_row", F.explode("rare").alias("key"))
    rare = rare.join(known.where(~frequent).select("key", "n"), "key").groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("base"), F.count("*").alias("known"))
    out = first.drop("rare", *(["score"] if len(groups) > 1 else []))
    if len(groups) > 1:
        out = out.join(parts.groupBy("_row").agg(F.sum("score").alias("score")), "_row")
    out = out.join(rare, "_row", "left")
    base = F.col("base_top") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log10(sums["n"] + sums["v"] + 1))
    return out.select("doc_id", "n_tokens", (F.col("known_top") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(sums["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _pass(docs: DataFrame, held, with_words: bool, with_unknown: bool, all_ends: list[int], order: int) -> DataFrame:
    """One pass over the texts: code lengths of the positions of a shard (the first pass also takes those of no shard, and words)."""
    ends_of_all = np.array(all_ends, np.int64) if with_unknown else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ends, top = held.value
        mine = None
        if ends is not None:
            mine = np.zeros(1 << 16, bool)
            if ends_of_all is not None:
                mine[:] = True
                mine[ends_of_all] = False
            mine[ends] = True
        frequent = Table(top[0].view(np.uint64)) if top is not None else None
        gain = np.log10(top[1] + 1.0) if top is not None else None
        for b in batches:
            for i, j, data, at in slices(b.column(2), SLICE):
                owner, gram, row, h = sequences(data, at, order)
                if mine is not None:
                    sel = mine[((gram >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
                    owner, gram = owner[sel], gram[sel]
                rows = j - i
                total = pa.array(np.bincount(owner, trie.cost(gram), rows).astype(np.float64))  # whole numbers if there is none
                ids = [b.column(0)[i:j], b.column(1)[i:j]]
                if not with_words:
                    none = pa.nulls(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*ids, none, none, pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.list_(pa.int64())), total], names=NAMES)
                    continue
                row, h = np.r_[row, np.arange(rows)], np.r_[h, np.full(rows, END_WORD)]
                place = frequent.places(h.view(np.uint64))
                got = place >= 0
                rest = np.flatnonzero(~got)
                rest = rest[np.argsort(row[rest], kind="stable")]
                cut = np.searchsorted(row[rest], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row[got], minlength=rows)), pa.array(np.bincount(row[got], gain[place[got]], rows).astype(np.float64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[rest])), total], names=NAMES
                )

    return docs.mapInArrow(run, "_row long, doc_id long, n_tokens long, known_top long, base_top double, rare array<bigint>, score double")


NAMES = ["_row", "doc_id", "n_tokens", "known_top", "base_top", "rare", "score"]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.where(remainder(F.col("doc_id"), 7) != 2))
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_ppm_score": op2}
ORACLES: dict = {}
