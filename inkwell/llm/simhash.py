"""Operator 5: near-duplicates by SimHash and pivot distance tables.

A fingerprint bit is 1 if it is set in over half the hashes of a document's word shingles. Equal fingerprints are grouped
first (with partial aggregation), so all that follows is about distinct fingerprints ("nodes").

Pivot tables: Hamming distances to PIVOTS reference fingerprints are precomputed inside each table's bits. Two nodes that
agree in a table's bits agree in all its coordinates, so the hash of a table's coordinate vector is a join key. Pairs that
meet in a table are discarded if any coordinate over all bits differs by more than the distance limit, and survivors are
verified by Hamming distance.

* exact mode (`exact_tables`): bits form blocks, two more than the limit, and each choice of two unbroken blocks is a table;
  nodes within the limit (2) agree in at least one table, so no link is lost.
Crowded keys: up to CROWD nodes of a key are paired. For keys with more, nodes are gathered around all strings at one differing
bit or none: nodes within 2 bits share such a centre, a centre has at most 65 nodes, each star links all of them, so nothing is
lost and no group is paired out.

Shingle sets that are similar (Jaccard) at a threshold t, 0.8 for instance: `wide_duplicates` first links them by fingerprints and
pivot tables (`print_pairs`: WIDE_TABLES tables of WIDE_BITS bits, in each key a star around one of its nodes, the pivot test and
WIDE_LIMIT bits at most), and verifies each such pair on the sets. At t sets can differ in more bits than that; what fingerprints leave is found by
an exact prefix join, at every input size:

* Nodes are distinct shingle sets. Each set is put in one order for all, common shingles last (counts of a sample; any order gives
  the same result). Two sets of sizes n, m that reach t share at least t / (1 + t) * (n + m) shingles, so their first common shingle
  is in both prefixes (`prefix`), and at places i, j with min(n - i, m - j) no less than that. Only such pairs are looked at, so
  members of a family with a common template that stay under t share no key in most cases.
* Keys of one node only, which most are, are found by partial aggregation and leave before anything is joined.
* Each key's nodes are compared with one of them first, but where fingerprints have linked them already (crowded keys, over CROWDED nodes, take one of LEADERS turns, so a family
  has a few). While all pairs that are left would be many, nodes outside a key's largest component are compared with a few inside
  (FEW on average), in up to TURNS rounds, while a round finds FRUITFUL links a node. Of the pairs that are left then, those inside one component of the
  links found so far can't change the result; all others are compared by their bits, in blocks of BLOCK nodes. Where the bits leave many
  (DEAR a node), each node's nearest pair is verified first, in up to TURNS rounds, and what has come into one component leaves.
  Families just under t that share their rarest shingles cost a comparison of bits for each pair; none is left out.
* A pair is first judged by parity bits: bit k of a set's bits tells whether an odd number of its shingles falls to place k, so two
  sets differ in at least as many shingles as their bits do. What the bits leave is verified on the shingle sets themselves; sets are
  made again from the texts of such nodes only, and a link carries the set of one end.

Components come from joining nodes to their least neighbours, with pointer jumping, and going on with the links between the groups; each
round is a stored table.

Defined cases: null text counts as empty; a document without words has fingerprint zero and is linked like any other;
repeated rows are copies; a null doc_id is a document, and never the smallest unless alone; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import LOWER, SPACE, STEP, mixed, slices, word_hashes, words
from inkwell.tables import discard, stored, table

PIVOTS = 16
CROWD = 32
CROWDED = 16
BLOCK = 256
FEW = 2
TURNS = 4
DEAR = 8  # comparisons a row
FRUITFUL = 0.02  # links a node: a round that finds fewer is followed by the last one
LEADERS = 4
WIDE_TABLES, WIDE_BITS, WIDE_LIMIT = 12, 24, 8
PARTS = 16
SAMPLE_ROWS, SAMPLE_PART = 20_000, 10  # the shingles of a tenth of the rows, or of so many if that is more, are counted for the order of the sets
HOT = 400_000  # shingles of known count at most: two numbers each, broadcast
ROWS_AT_ONCE = 1 << 15
BROADCAST_ROWS = 1_000_000  # of two numbers: 16 MB


def shingle_hashes(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64 with seed 42) of each space-joined n-word shingle of lower-cased words; fewer words: the whole sequence."""
    import xxhash

    start, end, row = words(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = end - start
    offset = np.cumsum(size + 1) - size - 1
    joined = np.full(offset[-1] + size[-1] + 1, 32, np.uint8)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = LOWER[data[~SPACE[data]]]
    whole = joined.tobytes()
    k = np.arange(len(row))
    first = np.searchsorted(row, row, "left")  # first word of each word's row
    count = np.searchsorted(row, row, "right") - first
    opens = (k - first <= count - n) | (k == first)
    b = k[opens]
    z = b + np.minimum(n, count[opens]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[x:y], 42) for x, y in zip(offset[b].tolist(), (offset[z] + size[z]).tolist(), strict=True)), np.uint64, len(b))
    return row[b], h


def majority(row: np.ndarray, h: np.ndarray, rows: int, longs: int = 1) -> np.ndarray:
    """rows x longs fingerprints (int64); further 64-bit words come from mixing the hash with a constant."""
    out = np.zeros((rows, longs), np.int64)
    total = np.bincount(row, minlength=rows)
    for w in range(longs):
        votes = np.zeros((rows, 64), np.int32)
        for i in range(0, len(h), ROWS_AT_ONCE):
            x, r = h[i : i + ROWS_AT_ONCE], row[i : i + ROWS_AT_ONCE]
            if w:
                with np.errstate(over="ignore"):
                    x = mixed(x + np.uint64(w) * np.uint64(0x9E3779B97F4A7C15))
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            votes[r[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(votes * 2 > total[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    return out


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], h[new]


def fingerprints(docs: DataFrame, shingle: int = 3, longs: int = 1, distinct: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys (whole numbers), w0 ... : one row a document. distinct: repeated shingles of a document count once."""
    names = [f"w{k}" for k in range(longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in slices(b.column(len(keys))):
                row, h = shingle_hashes(data, at, shingle)
                row, h = _distinct(row, h) if distinct else (row, h)
                prints = majority(row, h, j - i, longs)
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(len(keys))), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(longs))], names=[*keys, *names])

    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(run, ", ".join(f"{x} long" for x in (*keys, *names)))


def exact_tables(limit: int = 2, longs: int = 1) -> np.ndarray:
    """Masks (tables x longs, uint64): all choices of two of limit + 2 equal blocks of bits."""
    bits = 64 * longs
    owner = np.arange(bits) * (limit + 2) // bits
    return np.stack([_mask(np.isin(owner, c)) for c in combinations(range(limit + 2), 2)])


def wide_tables() -> np.ndarray:
    """Masks (WIDE_TABLES x 1, uint64) of WIDE_BITS bits each, the same in every run."""
    rng = np.random.default_rng(11)
    return np.stack([_mask(np.isin(np.arange(64), rng.permutation(64)[:WIDE_BITS])) for _ in range(WIDE_TABLES)])


def _mask(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits).view(">u8").astype(np.uint64)


def _pivots(longs: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, (PIVOTS, longs), np.uint64)


def table_keys(nodes: DataFrame, longs: int, masks: np.ndarray) -> DataFrame:
    """key, node: for each node and table the hash of its pivot distances inside the table's bits."""
    pivots = _pivots(longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.stack([b.column(1 + k).to_numpy().view(np.uint64) for k in range(longs)], 1)
            for t, mask in enumerate(masks):
                key = np.full(len(w), t + 1, np.uint64)
                for p in pivots:
                    distance = np.bitwise_count((w ^ p) & mask).sum(1).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + distance
                yield pa.RecordBatch.from_arrays([pa.array(mixed(key).view(np.int64)), b.column(0)], names=["key", "node"])

    return nodes.select("node", *[f"w{k}" for k in range(longs)]).mapInArrow(run, "key long, node long")


def _far(a: str, b: str, longs: int) -> Column:
    total = F.lit(0)
    for k in range(longs):
        total = total + F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}")))
    return total


def _coordinates(nodes: DataFrame, longs: int) -> DataFrame:
    """Adds p: the precomputed distances over all bits to the first 8 pivots."""
    pivots = _pivots(longs)[:8].view(np.int64)
    one = lambda p: sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.lit(int(p[k])))) for k in range(longs)), F.lit(0))
    return nodes.select("node", *[f"w{k}" for k in range(longs)], F.array(*[one(p).cast("short") for p in pivots]).alias("p"))


def _close(pairs: DataFrame, nodes: DataFrame, longs: int, limit: int) -> DataFrame:
    """a, b of pairs that pass the pivot test and are within the limit, with the distance."""
    c = _coordinates(nodes, longs)
    at = lambda name: c.select(F.col("node").alias(name), F.struct("p", *[f"w{k}" for k in range(longs)]).alias(f"_{name}"))
    j = pairs.join(at("a"), "a").join(at("b"), "b")
    spread = F.array_max(F.zip_with("_a.p", "_b.p", lambda x, y: F.abs(x - y)))
    return j.where(spread <= limit).withColumn("distance", _far("_a", "_b", longs)).where(F.col("distance") <= limit).select("a", "b", "distance")


def links(nodes: DataFrame, longs: int, masks: np.ndarray, limit: int, exact: bool = True, crowd: int = CROWD) -> DataFrame:
    """a, b, distance: links between distinct fingerprints, a < b, as the module's text says; a stored table."""
    if not exact:
        raise ValueError("links are exact; wide_duplicates has larger distances")
    keyed = stored(table_keys(nodes, longs, masks), "simhash-keys")
    counts = keyed.groupBy("key").count()
    crowded = stored(counts.where(F.col("count") > crowd).select("key"), "simhash-crowded")
    few = keyed.join(counts.where(F.col("count").between(2, crowd)).select("key"), "key", "left_semi")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    out = _close(pairs, nodes, longs, limit)
    many = keyed.join(crowded, "key", "left_semi")
    w = nodes.join(many.select("node").distinct(), "node", "left_semi")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(int(np.uint64(1 << k).astype(np.int64))) for k in range(64)])
    centres = w.select("node", F.explode(flips).alias("flip")).select("node", F.col("node").bitwiseXOR(F.col("flip")).alias("centre"))
    stars = centres.groupBy("centre").agg(F.collect_set("node").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b").distinct()
    out = out.unionByName(stars.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))))
    out = stored(out, "simhash-links")
    discard(keyed, crowded)
    return out


def print_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (node, w0) that meet in a pivot table, pass the pivot test and differ in WIDE_LIMIT bits or fewer; a stored table.

    Each key's nodes meet one of them, another one in another table, so there are at most WIDE_TABLES pairs a node."""
    keyed = stored(table_keys(nodes, 1, wide_tables()), "wide-tables")
    first = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(LEADERS))), "node")).alias("l"), F.count("*").alias("all"))
    first = stored(first.where("all > 1").select("key", F.col("l.node").alias("a")), "wide-centres")
    met = keyed.withColumnRenamed("node", "b").join(_small(first), "key").where("a != b")
    out = stored(_close(_in_order(met), nodes, 1, WIDE_LIMIT).select("a", "b"), "wide-prints")
    discard(keyed, first)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that can be reached over edges (a, b); a stored table.

    Each round joins a node to its least neighbour and follows these steps to their ends; only edges between different ends go
    on to the next round, which has half the nodes at most. So the rows joined are a small multiple of the edges."""
    left, rounds = stored(edges.select("a", "b"), "edges"), []
    while True:
        both = left.union(left.select("b", "a"))
        label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
        while True:
            jump = label.select(F.col("node").alias("l"), F.col("label").alias("far"))
            new = stored(label.select("node", F.col("label").alias("l")).join(jump, "l").select("node", F.col("far").alias("label"), (F.col("far") != F.col("l")).alias("moved")), "labels")
            discard(label)
            label = new
            if label.where("moved").isEmpty():
                break
        rounds.append(label)
        end = lambda x, label=label: label.select(F.col("node").alias(x), F.col("label").alias(f"{x}_"))
        parted = left.join(end("a"), "a").join(end("b"), "b").where("a_ != b_")
        was, left = left, stored(parted.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), "edges")
        discard(was)
        if left.isEmpty():
            discard(left)
            break
    out = rounds.pop().select("node", "label")
    used = [label]
    while rounds:
        used.append(rounds.pop())
        far = out.select(F.col("node").alias("label"), F.col("label").alias("far"))
        out = used[-1].select("node", "label").join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = stored(out, "labels")
    discard(*used)
    return out


def _linked(label: DataFrame, more: DataFrame) -> DataFrame:
    """The components `label`, after the links (a, b) of more as well; a stored table. Only links between components are followed."""
    new = components(_named(more, label).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    far = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
    known = label.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = stored(known.unionByName(new.join(label, "node", "left_anti")), "labels")
    discard(label, new)
    return out


def _followed(label: DataFrame, more: DataFrame) -> tuple[DataFrame, int]:
    """`label` after the links of more, a stored table that is deleted, and their number."""
    joined = more.count()
    label = _linked(label, more) if joined else label
    discard(more)
    return label, joined


def _named(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Adds la and lb to pairs (a, b): the components of both ends, or the ends themselves where no link is known."""
    at = lambda x: _small(label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select(*pairs.columns, F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: documents whose 64-bit fingerprints link at `limit` (2) bits or fewer."""
    if limit > 2:
        raise ValueError("exact stars cover distances up to 2; wide_duplicates has more")
    prints = stored(fingerprints(docs, shingle).withColumnRenamed("w0", "node"), "simhash")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least")).withColumn("w0", F.col("node")), "simhash-nodes")
    found = links(nodes, 1, exact_tables(limit), limit, exact=True)
    label = components(found)
    named = nodes.join(label.select("node", "label"), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = stored(named.join(ids, "label").select("node", "component_id"), "simhash-components")
    discard(found, label, nodes)
    return prints.join(by_node, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, ranks), both sorted by hash: the shingles that a sample of docs has three times or more, rarest first."""
    every = min(SAMPLE_PART, max(1, docs.count() // SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                s, c = np.unique(shingle_keys(data, at, shingle)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c)], names=["s", "c"])

    sample = docs.where(F.pmod(F.xxhash64("h"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c > 2")
    found = counted.orderBy(F.desc("c"), "s").limit(HOT).toArrow()
    s = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order], (len(s) - order).astype(np.int64)


def prefix(row: np.ndarray, h: np.ndarray, rows: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the sets, ends of the prefixes, shingles of the prefixes) of distinct shingles h by row.

    A set of n has n - ceil(similarity * n) + 1 shingles in its prefix: common ones last, else by hash."""
    last = np.zeros(len(h), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        last = np.where(common[place] == h, rank[place], 0)
    order = np.lexsort((h, last, row))
    size = np.bincount(row, minlength=rows)
    long = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    return size, np.cumsum(long), h[order][at < np.repeat(long, size)]


def parity(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, 64-bit words): for each row, bit k tells whether an odd number of its hashes falls to place k.

    A set of n has the power of two from n on for its places, 64 at least; the longer of two rows folds to the shorter by XOR."""
    wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(wide) - wide
    at = base[row] + (h & (wide[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(wide.sum())) & 1).astype(np.uint8)
    return np.cumsum(wide >> 6), np.packbits(odd, bitorder="little").view("<i8")


def shingle_keys(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of the distinct n-word shingles of each row, sorted; fewer words: the whole sequence."""
    low = LOWER[data]
    start, end, row = words(low, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(low, start, end)
    k = np.arange(len(row))
    first = np.searchsorted(row, row, "left")
    count = np.searchsorted(row, row, "right") - first
    out = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(n):
            there = (k - first + step < count) if step else np.ones(len(k), bool)
            out = np.where(there, out * STEP + h[np.minimum(k + step, len(h) - 1)], out)
    opens = (k - first <= count - n) | (k == first)
    return _distinct(row[opens], mixed(out[opens]))


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether sets with sizes n, m that share the shingle at places i, j can be similar, if it is the first they share."""
    n, m, i, j = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    return F.least(n - i, m - j) >= (n + m) * (similarity / (1 + similarity)) - 1e-6


def _folded(bits: Column, other: Column) -> Column:
    half = F.shiftright(F.size(bits), 1)
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def _apart(a: str, b: str) -> Column:
    """The number of parity bits in which two sets differ: no more than the shingles that only one of them has."""
    x, y = F.col(f"{a}bits"), F.col(f"{b}bits")
    return F.aggregate(F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + z)


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether the parity bits of two sets don't rule out that they are similar."""
    n = F.col(f"{a}n") + F.col(f"{b}n")
    return (n - _apart(a, b)) / 2 >= n * (similarity / (1 + similarity)) - 1e-6


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose parity bits don't rule out that their sets are similar; a stored table."""
    at = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}n"), F.col("bits").alias(f"{name}bits"))
    return stored(pairs.join(at("a"), "a").join(at("b"), "b").where(_near("a", "b", similarity)).select("a", "b"), "wide-likely")


def _similar(likely: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b), a stored table, whose shingle sets are similar, made again from the texts of docs; a stored table."""
    if likely.isEmpty():
        return likely
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    wanted = stored(ends.join(nodes, "node").select("node", F.col("least.id").alias("id_"), F.col("least.h").alias("h_"), F.col("least.rows").alias("rows")), "wide-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in slices(b.column(1)):
                row, h = shingle_keys(data, at, shingle)
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64)))], names=["node", "shingles"])

    of = lambda some: docs.join(_small(some), F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).select("node", "text")
    texts, repeated = of(wanted.where("rows = 1")), wanted.where("rows > 1")
    if not repeated.isEmpty():
        texts = texts.unionByName(of(repeated).dropDuplicates(["node"]))
    sets = stored(texts.mapInArrow(run, "node long, shingles array<bigint>"), "wide-sets")
    ends = _small(likely.select(F.col("a").alias("node")).distinct())
    one = sets.join(ends, "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    both = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")).join(_small(likely), "b").join(one.hint("merge"), "a")
    both = both.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("c"), (F.size("_a") + F.size("_b")).alias("n"))
    out = stored(both.where(F.col("c") >= similarity * (F.col("n") - F.col("c")) - 1e-9).select("a", "b"), "wide-close")
    discard(likely, wanted, sets)
    return out


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


SIDE = ("node", "n", "pos", "label", "bits")


def _open(held: DataFrame, label: DataFrame) -> tuple[DataFrame, float]:
    """Rows (key, node, n, pos, bits) of held (node, n, bits, at) under keys whose nodes the links behind label leave in more than one
    component, with label, main (the key's largest component), rest (nodes outside it) and most (inside); a stored table.
    And how many comparisons a row `_across` would make. Nodes take their labels before their keys are rows."""
    named = held.join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    m = named.select("node", "label", "n", "bits", F.inline("at"))
    parts = m.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    parts = stored(parts.where("most < all").select("key", "main", "most", (F.col("all") - F.col("most")).alias("rest")), "wide-parts")
    out = stored(m.join(_small(parts), "key"), "wide-open")
    all_ = F.col("rest") + F.col("most")
    cost = parts.agg((F.sum(F.col("rest") * all_) / F.sum(all_)).alias("c")).first()["c"]
    discard(parts)
    return out, cost or 0.0


def _sides(rest: DataFrame, whole: DataFrame, by: str, similarity: float) -> DataFrame:
    """a, b, d: pairs of rest with whole under one key and number `by` that may be similar and are in two components; stored.
    d is the least share of their shingles in which they differ."""
    x = rest.select("key", by, *[F.col(c).alias(f"a{c}") for c in SIDE])
    y = whole.select("key", by, *[F.col(c).alias(f"b{c}") for c in SIDE])
    both = x.join(y, ["key", by]).where((F.col("alabel") != F.col("blabel")) & _fits("a", "b", similarity) & _near("a", "b", similarity))
    share = (_apart("a", "b") / (F.col("an") + F.col("bn"))).alias("d")
    return stored(both.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"), share).dropDuplicates(["a", "b"]), "wide-across")


def _some(m: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each node outside its key's largest component with a few nodes inside, other ones under each key and turn.

    That joins most members of a family, so that few pairs are left for `_across`."""
    bins = F.ceil(F.col("most") / FEW)
    rest = m.where("label != main").withColumn("bin", F.pmod(F.xxhash64("node", "key", F.lit(turn)), bins))
    return _sides(rest, m.where("label = main").withColumn("bin", F.pmod(F.xxhash64("key", "node", F.lit(turn)), bins)), "bin", similarity)


def _across(m: DataFrame, similarity: float) -> DataFrame:
    """All pairs of the rows of `_open` that are in two components: at most one end of such a pair is in the component with
    most of its key's nodes, so the others, in blocks, meet all."""
    blocks = F.ceil(F.col("rest") / BLOCK)
    rest = m.where("label != main").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    return _sides(rest, m.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))), "block", similarity)


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, d) those with the least d of one of their ends; a stored table."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "d").union(pairs.select("b", "a", "d"))
    best = ends.groupBy("node").agg(F.min_by("other", F.struct("d", "other")).alias("other"))
    return stored(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "wide-nearest")


def wide_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, h, n, component: groups among docs(id, h, text) whose sets of word shingles are similar (Jaccard) at `similarity` or
    more; a stored table with a row for each (id, h), which n rows of docs have. h is a hash of the text.

    All pairs are found, as the module's text says, and verified on the shingle sets themselves."""
    order_of = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for i, j, data, at in slices(b.column(2)):
                row, h = shingle_keys(data, at, shingle)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                node = np.fromiter((xxhash.xxh64_intdigest(h[x:y].tobytes(), 7) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), np.uint64, j - i)
                size, ends, keys = prefix(row, h, j - i, similarity, *order_of.value)
                stops, bits = parity(row, h, size)
                prints = majority(row, h, j - i)[:, 0]
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, e], pa.int32()), pa.array(x)) for e, x in ((ends, keys.view(np.int64)), (stops, bits))]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(node.view(np.int64)), pa.array(size, pa.int32()), pa.array(np.ascontiguousarray(prints)), *lists], names=["id", "h", "node", "size", "w0", "keys", "bits"])

    prints = stored(docs.select("id", "h", "text").mapInArrow(first, "id long, h long, node long, size int, w0 long, keys array<bigint>, bits array<bigint>"), "wide")
    rows = stored(prints.groupBy("id", "h", "node").agg(F.count("*").alias("rows"), F.first("size").alias("n"), F.first("w0").alias("w0"), F.first("bits").alias("bits")), "wide-rows")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("id", "h", "rows")).alias("least"), F.first("n").alias("n"), F.first("w0").alias("w0"), F.first("bits").alias("bits")), "wide-nodes")
    similar = lambda pairs: _similar(pairs, nodes, docs, shingle, similarity)
    met = print_pairs(nodes)
    close = similar(_likely(met, nodes, similarity))
    label = components(close)
    discard(met, close)
    keyed = prints.select("node", F.col("size").alias("n"), F.posexplode("keys").alias("pos", "key"))
    smaller = F.col("n") - F.col("pos") >= F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6)  # can be the smaller side
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max(smaller).alias("small")).where("a < b and small")
    shared = stored(shared.select("key"), "wide-keys")
    met = stored(keyed.join(_small(shared), "key").dropDuplicates(["key", "node"]), "wide-met")
    order = lambda turn: F.struct(F.xxhash64("node", turn).alias("o"), "node", "n", "pos")
    lead = met.groupBy("key").agg(F.count("*").alias("all"), F.min(order(F.lit(0))).alias("few"), F.min(order(F.pmod("key", F.lit(LEADERS)))).alias("many"))
    lead = stored(lead.select("key", "all", F.when(F.col("all") > CROWDED, F.col("many")).otherwise(F.col("few")).alias("l")), "wide-leaders")
    led = met.select("key", F.col("node").alias("bnode"), F.col("n").alias("bn"), F.col("pos").alias("bpos")).join(_small(lead.select("key", *[F.col(f"l.{c}").alias(f"a{c}") for c in ("node", "n", "pos")])), "key")
    near = _in_order(led.where("anode != bnode").where(_fits("a", "b", similarity)).select(F.col("anode").alias("a"), F.col("bnode").alias("b")))
    parted = _named(near, label).where("la != lb").select("a", "b")  # fingerprints have linked the others
    label, _ = _followed(label, similar(_likely(parted, nodes, similarity)))
    leaders = _small(lead.where("all > 2").select("key", F.col("l.node").alias("lead")))
    at = met.join(leaders, "key").where("node != lead").groupBy("node").agg(F.collect_list(F.struct("key", "pos")).alias("at"))  # pairs with a leader are judged
    held = stored(nodes.select("node", "n", "bits").join(at, "node"), "wide-held")
    m, cost = _open(held, label)
    turn, fruitful, last = 0, FRUITFUL * held.count(), cost <= DEAR
    while not last:  # rounds of some pairs while they find many links
        label, joined = _followed(label, similar(_some(m, turn, similarity)))
        turn += 1
        last = turn == TURNS or joined < fruitful
        if joined >= fruitful:  # else the rows of m, with the labels they have, serve the last round
            was = m
            m, cost = _open(held, label)
            discard(was)
            last = last or cost <= DEAR
    pairs, joined = _across(m, similarity), fruitful  # all pairs that are left; where they are many, each node's nearest first
    for _ in range(TURNS):
        best = _nearest(pairs)
        if joined < fruitful or pairs.count() <= DEAR * best.count():
            discard(best)
            break
        left = stored(pairs.join(best, ["a", "b"], "left_anti"), "wide-across")
        label, joined = _followed(label, similar(best))  # which deletes best
        discard(pairs)
        pairs = stored(_named(left, label).where("la != lb").drop("la", "lb"), "wide-across")
        discard(left)
    label, _ = _followed(label, similar(pairs))
    discard(m, held)
    discard(shared, met, lead, prints, nodes)
    out = rows.join(label.select("node", "label"), "node", "left").select("id", "h", F.col("rows").alias("n"), F.coalesce("label", "node").alias("component"))
    out = stored(out, "wide-components")
    discard(label, rows)
    return out


def _small(keys: DataFrame) -> DataFrame:
    """A stored table of few columns, broadcast if it has BROADCAST_ROWS or fewer; beyond that, both sides are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the least doc_id (nulls last) stays. Columns as given.

    Rows are known by doc_id and a hash of the text; of rows that agree in both, the least by all columns stays."""
    keyed = docs.select(F.struct("*").alias("d")).select("d", F.col("d.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("d.text", F.lit(""))).alias("h"))
    group = wide_duplicates(keyed.select("id", "h", F.col("d.text").alias("text")), shingle, similarity)
    stays = group.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("s"), F.sum("n").alias("all"))
    stays = stored(stays.where("all > 1").select("component", "s"), "near-stays")
    few = _small(stays)
    if few is stays:  # not broadcast: a large group is dealt to PARTS tasks
        parts = F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")
        group, few = group.withColumn("part", F.pmod(F.xxhash64("id", "h"), F.lit(PARTS))), stays.withColumn("part", F.explode(parts))
    judged = group.join(few, [c for c in ("component", "part") if c in few.columns]).withColumn("stays", F.col("id").eqNullSafe(F.col("s.id")) & (F.col("h") == F.col("s.h")))
    goes = stored(judged.where("not stays or n > 1").select(F.col("id").alias("id_"), F.col("h").alias("h_"), "stays"), "near-goes")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    out = keyed.join(_small(goes), same, "left_anti").select("d")
    repeated = goes.where("stays")
    if not repeated.isEmpty():
        one = keyed.join(_small(repeated), same).groupBy("id", "h").agg(F.min("d").alias("d")).select("d")
        out = out.unionByName(one)
    return out.select("d.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash": op5}
ORACLES: dict = {}
