"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Texts and test items become sequences of terms (runs of letters, digits and non-ASCII bytes, A-Z lowered; punctuation, case
and line breaks don't matter). An item of m terms has an error budget k = floor(m * rate) of inserted, lost or changed terms
and is split into k + 1 pieces of nearly equal length: a document that holds the item within the budget holds at least one
piece unchanged. Pieces are found by hashes of consecutive terms, and each hit's surroundings are verified by Myers'
bit-parallel distance (item against any stretch of the window).

The items of one block are broadcast (at most `block_terms` terms); more items are taken in blocks, each against all rows,
so the broadcast doesn't grow. Documents are not shuffled.

Defined cases: null or empty texts hold nothing; items under `least` terms (3) are no evidence and are left out; repeated
documents each get their rows; repeated item rows or ids are matched once per item row and reported by item_id; a null
item_id is kept; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import LOWER, NO_TERM, slices, word_hashes, words
from inkwell.tables import table

RATE = 0.2
LEAST = 3
BLOCK_TERMS = 1_000_000
ROLL = np.uint64(0xC2B2AE3D27D4EB4F)


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the terms in order."""
    start, end, row = words(data, at, NO_TERM)
    return row, word_hashes(LOWER[data], start, end)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive terms; none where there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * ROLL + h[k : len(h) - n + 1 + k]
    return out


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches (start, end) that cover m terms."""
    return [(m * i // (k + 1), m * (i + 1) // (k + 1)) for i in range(k + 1)]


def least_distance(peq: dict[int, int], m: int, window: list[int]) -> tuple[int, int]:
    """(distance, end) of the stretch of window nearest to the item (Myers 1999; the earliest on ties)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, t in enumerate(window):
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, ids: list, texts: list, rate: float, least: int):
        self.ids, self.budget, self.peq, self.size = [], [], [], []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = terms(raw, np.array([0, len(raw)]))[1]
            if len(h) < max(1, least):
                continue
            k, which = int(len(h) * rate), len(self.ids)
            peq: dict[int, int] = {}
            for i, t in enumerate(h.tolist()):
                peq[t] = peq.get(t, 0) | 1 << i
            self.ids.append(item)
            self.budget.append(k)
            self.peq.append(peq)
            self.size.append(len(h))
            for a, b in pieces(len(h), k):
                found.setdefault(b - a, {}).setdefault(int(runs(h[a:b], b - a)[0]), []).append((which, a))
        self.tables = {}
        for n, by in found.items():
            keys = np.array(sorted(by), np.uint64)
            likely = np.zeros(1 << 20, bool)
            likely[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[n] = (keys, likely, [by[int(x)] for x in keys])

    def search(self, row: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first term, end term): the best match of each item in each row."""
        hits: dict[tuple[int, int], set[int]] = {}
        bounds: dict[int, tuple[int, int]] = {}
        for n, (keys, likely, owners) in self.tables.items():
            r = runs(h, n)
            maybe = np.flatnonzero(likely[(r >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[row[maybe] == row[maybe + n - 1]]
            place = np.searchsorted(keys, r[maybe])
            place[place == len(keys)] = 0
            hit = keys[place] == r[maybe]
            for at, p in zip(maybe[hit].tolist(), place[hit].tolist(), strict=True):
                for which, offset in owners[p]:
                    hits.setdefault((int(row[at]), which), set()).add(at - offset)
        for (doc, which), starts in sorted(hits.items()):
            if doc not in bounds:
                bounds[doc] = (int(np.searchsorted(row, doc, "left")), int(np.searchsorted(row, doc, "right")))
            first, last = bounds[doc]
            m, k = self.size[which], self.budget[which]
            best, windows = (k + 1, 0, 0), []
            for s in sorted(starts):  # overlapping surroundings become one window
                a, b = max(first, s - k), min(last, s + m + 2 * k + 1)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                distance, end = least_distance(self.peq[which], m, h[a:b].tolist())
                if distance < best[0]:
                    best = (distance, max(first, a + end - m) - first, a + end - first)
            if best[0] <= k:
                yield doc, which, *best


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """doc_id, item_id, distance, item_terms, start_term, end_term: each document's best match of each item it holds."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [_against(source, block, rate, least) for block in _blocks(items, block_terms)])


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The rows of docs that hold no item; all columns as given, without a shuffle."""
    return reduce(lambda d, block: _filtered(d, block, rate, least), _blocks(items, block_terms), docs)


def _blocks(items: DataFrame, block_terms: int) -> list[DataFrame]:
    sized = items.select("item_id", "text", (F.floor(F.length(F.coalesce("text", F.lit(""))) / 2) + 1).alias("most"))
    total = sized.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    return [sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def _held(spark: SparkSession, items: DataFrame):
    rows = items.select("item_id", "text").orderBy("item_id", "text").collect()  # one block of bounded size
    return spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))


def _filtered(docs: DataFrame, items: DataFrame, rate: float, least: int) -> DataFrame:
    held, at_ = _held(docs.sparkSession, items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(*held.value, rate, least)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, _, data, at in slices(b.column(at_)):
                for d, *_rest in block.search(*terms(data, at)):
                    keep[i + d] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _against(docs: DataFrame, items: DataFrame, rate: float, least: int) -> DataFrame:
    held = _held(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(*held.value, rate, least)
        for b in batches:
            for i, j, data, at in slices(b.column(1)):
                found = [(b.column(0)[i + d].as_py(), block.ids[w], dist, block.size[w], s, e) for d, w, dist, s, e in block.search(*terms(data, at))]
                if found:
                    types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["doc_id", "item_id", "distance", "item_terms", "start_term", "end_term"])

    return docs.mapInArrow(run, "doc_id long, item_id long, distance int, item_terms int, start_term int, end_term int")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9}
ORACLES: dict = {}
