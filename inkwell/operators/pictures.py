"""Perceptual image hashes as 64-bit numbers: making them from brightness grids, and pairs of hashes that are near."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.tables import stored

SAME = 8
#: Hashes of one side in a task (32 MB), pairs that are compared at once.
SHARD, PAIRS = 4_000_000, 1_000_000


def difference_hash(grid: Column) -> Column:
    """16 hex digits from 72 brightness values (8 rows of 9): a bit for each value greater than its right neighbour."""
    bit = lambda i: F.when(F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")) > F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 2).cast("int")), "1").otherwise("0")
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def is_trivial(grid: Column, width: Column, height: Column) -> Column:
    """Too small or too plain to compare."""
    mean = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x) / F.size(grid)
    spread = F.sqrt(F.aggregate(grid, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(grid))
    return (width < 48) | (height < 48) | (spread < 6)


def as_number(hash_: Column) -> Column:
    """A hex hash as a signed 64-bit number."""
    half = lambda a: F.conv(F.substring(hash_, a, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(as_number(a).bitwiseXOR(as_number(b)))


def _masks(limit: int, together: int) -> list[tuple[int, list[int]]]:
    """(bits of `together` of limit + together blocks, the blocks below its last one that it leaves out)."""
    n = limit + together
    cuts = [64 * k // n for k in range(n + 1)]
    ones = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(n)]
    return [(sum(ones[k] for k in ks), [ones[k] for k in range(ks[-1]) if k not in ks]) for ks in combinations(range(n), together)]


def _met(x: np.ndarray, y: np.ndarray, mask: int, less: list[int], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, distance) of near hashes that agree in the mask's bits and in no set of blocks that comes before it."""
    m = np.uint64(mask)
    x, y = x[np.argsort(x & m)], y[np.argsort(y & m)]
    key = y & m
    lo, hi = np.searchsorted(key, x & m, "left"), np.searchsorted(key, x & m, "right")
    upto = np.cumsum(hi - lo)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        n = hi[i:j] - lo[i:j]
        a = np.repeat(x[i:j], n)
        b = y[np.arange(len(a)) + np.repeat(lo[i:j] - (np.cumsum(n) - n), n)]
        z = a ^ b
        d = np.bitwise_count(z)
        near = np.flatnonzero(d <= limit)
        for bits in less:
            near = near[(z[near] & np.uint64(bits)) != 0]
        if len(near):
            yield a[near], b[near], d[near]
        i = j


def near_hashes(mine: DataFrame, theirs: DataFrame, limit: int = SAME, together: int | None = None) -> DataFrame:
    """x, y, distance of distinct hashes (mine: x, theirs: y) that differ in `limit` bits or fewer, each pair once.

    64 bits in limit + `together` blocks: near hashes agree in `together` blocks at least. For each set of so many blocks both sides
    are sorted by its bits in one task's arrays and compared there, so no pair is a row before it is near. More hashes take more blocks,
    which leaves fewer of them to compare; more than a task's arrays should hold are dealt in shards that all meet."""
    n, m = mine.count(), theirs.count()
    if together is None:
        together = next(t for t, most in ((2, 1e9), (3, 3e11), (4, float("inf"))) if n * m <= most)
    masks = _masks(limit, together)
    groups = 1 if n * m <= 1e8 else min(len(masks), 33)
    k, l = -(-n // SHARD) or 1, -(-m // SHARD) or 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
        if left.num_rows and right.num_rows:
            x, y = (t.column(c).to_numpy().view(np.uint64) for t, c in ((left, "x"), (right, "y")))
            for mask, less in masks[left.column("g")[0].as_py() :: groups]:
                out += _met(x, y, mask, less, limit)
        a, b, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"x": a.view(np.int64), "y": b.view(np.int64), "distance": d.astype(np.int32)})

    all_ = lambda many, name: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    part = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    left = mine.select("x", part("x", k).alias("i"), all_(l, "j")).select("x", "i", "j", all_(groups, "g"))
    right = theirs.select("y", part("y", l).alias("j"), all_(k, "i")).select("y", "i", "j", all_(groups, "g"))
    return left.groupBy("i", "j", "g").cogroup(right.groupBy("i", "j", "g")).applyInArrow(meet, "x long, y long, distance int")


def near_pairs(images: DataFrame, others: DataFrame | None = None, limit: int = SAME, together: int | None = None) -> DataFrame:
    """a, b, transform, distance: pictures (id, hash, variants array<struct<transform, hash>>) that differ in `limit` bits or fewer in
    any transform of b. Within one table a < b. Equal hashes meet once (near_hashes); their pictures join what was found."""
    left = images.select(F.col("id").alias("a"), as_number(F.col("hash")).alias("x"))
    right = images if others is None else others
    right = right.select(F.col("id").alias("b"), F.explode(F.concat(F.array(F.struct(F.lit("same").alias("transform"), "hash")), "variants")).alias("v")).select("b", "v.transform", as_number(F.col("v.hash")).alias("y"))
    mine, theirs = stored(left.where("x is not null").select("x").distinct(), "hashes"), stored(right.where("y is not null").select("y").distinct(), "hashes")
    near = stored(near_hashes(mine, theirs, limit, together), "near")
    p = left.join(near, "x").join(right, "y")
    p = p.where("a < b") if others is None else p
    return p.groupBy("a", "b").agg(F.min(F.struct("distance", (F.col("transform") != "same").alias("other"), "transform")).alias("m")).select("a", "b", "m.transform", "m.distance")


def first_figures(pairs: DataFrame) -> DataFrame:
    """The nearest figure b of each picture a."""
    return pairs.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where("r = 1").drop("r")
