"""Operator 13: periodic runs of words, by a harmonic grid and prefix hashes.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(24, 3q) words
long, that no neighbouring word extends keeping the period. For each period p the words i of a run that have i + p in the
run are at least s(p) = max(24 - p, 2p) in a row, so one multiple of s(p) is among them: the grid. All (period, grid point)
pairs of a slice of texts, about n ln n of them for a text of n words, are looked at together: pairs whose two words differ
go at once, the others are extended to both sides by a binary search on prefix hashes for the longest common extension
(LCE), all in step. Stretches of sufficient length lose their multiples of the period (same ends, least period stays), and
what is left is compared word by word, byte by byte. If that finds a collision of hashes, the slice is done again with
another base and numbers instead of hashes of words, so results are exact.

Pairs are made in chunks of bounded size; memory follows the slice (256 KB of text, or one longer text).

Defined cases: null text has no words; a null doc_id counts as an empty string where the id's checksum matters; ties of the
strongest run go to the smallest start, then period; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored (`runs_of`) or kept (`collapsed`).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import slices, word_hashes, words
from inkwell.tables import table

LEAST = 24
TIMES = 3
PAIRS = 1 << 18
#: The largest prime below 2^32: products of two remainders fit 64 bits.
PRIME = np.uint64(4294967291)
PIECE = 1 << 16


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place inside it) for each of counts[which] places."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step % PRIME
        done += take
        step = step * step % PRIME
    return out


class Prefixes:
    """Prefix hashes of a sequence of numbers below PRIME."""

    def __init__(self, values: np.ndarray, base: int):
        self.power = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def same(self, i: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k values from i on have the hash of the k values from i + p on."""
        left = (self.sums[i + k] + PRIME - self.sums[i]) % PRIME * self.power[p] % PRIME
        return left == (self.sums[i + p + k] + PRIME - self.sums[i + p]) % PRIME

    def extension(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest k <= most for which the k values from i on (or before i) agree with those p further on."""
        k = np.zeros(len(i), np.int64)
        step = 1 << (int(most.max(initial=0)).bit_length())
        while step := step >> 1:
            at = np.flatnonzero(k + step <= most)
            more = k[at] + step
            ok = self.same(i[at] - more if back else i[at], p[at], more)
            k[at[ok]] = more[ok]
        return k


def _candidates(values: np.ndarray, first: np.ndarray, base: int, least: int, times: int, pairs: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of all stretches, least period first for equal ends; places count from the slice's start."""
    n = np.diff(first)
    row, p = _expand(np.where(n >= least, n // times, 0))
    p += 1
    step = np.maximum(least - p, (times - 1) * p)
    points = np.maximum(0, -(-(n[row] - p) // step))
    hashes, upto, found = Prefixes(values, base), np.cumsum(points), []
    j = 0
    while j < len(row):
        to = max(j + 1, int(np.searchsorted(upto, (upto[j - 1] if j else 0) + pairs, "right")))
        which, k = _expand(points[j:to])
        which += j
        i = first[row[which]] + k * step[which]
        alike = values[i] == values[i + p[which]]
        which, i = which[alike], i[alike]
        r, q = row[which], p[which]
        f = hashes.extension(i, q, first[r + 1] - q - i, False)
        b = hashes.extension(i, q, i - first[r], True)
        s, e = i - b, i + q + f
        ok = e - s >= np.maximum(least, times * q)
        found.append(_least(r[ok], s[ok], e[ok], q[ok]))
        j = to
    return _least(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def _least(row: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """One stretch for each (start, end): that of the least period."""
    order = np.lexsort((p, e, s))
    row, s, e, p = row[order], s[order], e[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return row[new], s[new], e[new], p[new]


def _bytes_agree(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether words a and words b are the same, byte by byte."""
    for at in range(0, len(a), PIECE):
        x, y = a[at : at + PIECE], b[at : at + PIECE]
        apart = x != y
        x, y = x[apart], y[apart]
        size = end[x] - start[x]
        if not np.array_equal(size, end[y] - start[y]):
            return False
        which, k = _expand(size)
        if not np.array_equal(data[start[x][which] + k], data[start[y][which] + k]):
            return False
    return True


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each distinct word, whatever its hash."""
    known: dict[bytes, int] = {}
    whole = data.tobytes()
    return np.array([known.setdefault(whole[s:e], len(known) + 1) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)


def find_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, index: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS, values: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of all runs of the rows of a slice, by start; places count from the slice's start.

    data, start, end: bytes and words; index: the word at each place; first: each row's first place, and the end."""
    values = (word_hashes(data, start, end) if values is None else values) % PRIME
    base = 1_000_003
    while True:
        found = _candidates(values[index], first, base, least, times, pairs)
        if all(_bytes_agree(data, start, end, index[s : e - p], index[s + p : e]) for _, s, e, p in zip(*(x.tolist() for x in found), strict=True)):
            return found
        values = _numbers(data, start, end)
        base = base * 7_368_787 % int(PRIME)


def stuttered(index: np.ndarray, doc_id: str) -> np.ndarray:
    """The word numbers of a text after the contract's change: in one text of ten, by the id's checksum, a piece repeats to the end."""
    h, n = zlib.crc32(doc_id.encode()), len(index)
    if h % 10 or not n:
        return index
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = index.copy()
    out[a:] = index[a] + np.arange(n - a) % p
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _texts(ids: pa.Array, texts: pa.Array, change: bool) -> Iterator[tuple[int, list[bytes], list[tuple[int, int, int]]]]:
    """(row, words, runs) of each text; a run is (start, length, period)."""
    for i, j, data, at in slices(texts):
        start, end, row = words(data, at)
        first = np.searchsorted(row, np.arange(j - i + 1))
        index = np.arange(len(start))
        if change:
            for r in range(j - i):
                if first[r + 1] > first[r]:
                    x = ids[i + r].as_py()
                    index[first[r] : first[r + 1]] = stuttered(index[first[r] : first[r + 1]], "" if x is None else str(x))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
        for r, s, e, p in zip(*(x.tolist() for x in find_runs(data, start, end, index, first)), strict=True):
            runs[r].append((s - int(first[r]), e - s, p))
        for r in range(j - i):
            held = data[at[r] : at[r + 1]].tobytes().split()
            k = index[first[r] : first[r + 1]] - first[r]
            if change and len(k) and (k != np.arange(len(k))).any():
                held = [held[x] for x in k.tolist()]
            yield i + r, held, sorted(runs[r], key=lambda x: (x[0], x[2]))


def _collapse(held: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        keep = kept_words(len(held), runs)
        held = [held[x] for x in np.flatnonzero(keep).tolist()]
    return b" ".join(held)


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: one row a run of each text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(b.column(0)[r].as_py(), *x) for r, _, runs in _texts(b.column(0), b.column(1), False) for x in runs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with repeats of runs cut out of their texts (words joined by one space there); texts without runs stay as they are."""
    at = docs.columns.index("text")
    known = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for r, held, runs in _texts(b.column(known), b.column(at), False):
                if runs:
                    texts[r] = _collapse(held, runs).decode()
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, change: bool = True) -> DataFrame:
    """One row a document: number of runs, the strongest of them, digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, held, runs in _texts(b.column(0), b.column(1), change):
                best = strongest(runs)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                rows.append((b.column(0)[r].as_py(), len(runs), *numbers, hashlib.sha256(lines).hexdigest(), hashlib.sha256(_collapse(held, runs)).hexdigest()))
            if rows:
                types = [*[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_periodic_runs": op13}
ORACLES: dict = {}
