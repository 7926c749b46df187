"""Sharding, vector codes and periodic runs: against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import periodic_runs, shard_balance, vector_codes
from oracle import difference
from test_llm_text_models import odd_docs


def plain_runs(w):
    """All runs of a word list by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def changed(doc_id, w):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    w = changed(doc_id, (text or "").encode().split())
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def rough_texts(rng, n):
    """Texts of a few words with repeats of all kinds: nested, touching, overlapping, cut short, with odd blanks."""
    for _ in range(n):
        w = []
        while len(w) < rng.randrange(5, 260):
            piece = [rng.choice(["a", "b", "été", "long-word"]) for _ in range(rng.randrange(1, 30))]
            w += (piece * rng.choice([1, 1, 3, 4, 9, 30]))[: rng.randrange(1, 150)]
        yield rng.choice(["", " ", "\n\t"]) + rng.choice([" ", "\n", "\x0b \r"]).join(w)


def test_runs_by_brute_force(spark):
    texts = ["", None, " \n", "x " * 23, "x " * 24, "x " * 25 + "y", "a b " * 11 + "a b a b", *rough_texts(random.Random(3), 300)]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in periodic_runs.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(plain_digest(*r) for r in rows)
    assert sum(r[1] > 1 for r in got) > 30 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15


def test_runs_of_the_table_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    got = {r.doc_id: tuple(r) for r in periodic_runs.op13(spark, small).collect()}
    rows = docs.collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert [got[r.doc_id] for r in rows] == [plain_digest(r.doc_id, r.text) for r in rows]


def test_runs_survive_collisions_and_small_chunks():
    data = np.frombuffer(b" ".join([b"p", b"q", b"r"] * 12 + [b"s", b"t"] * 20 + [b"u"] * 9), np.uint8)
    start, end, _ = periodic_runs.words(data, np.array([0, len(data)]))
    index, first = np.arange(len(start)), np.array([0, len(start)])
    want = [(0, 0, 36, 3), (0, 36, 76, 2)]
    lists = lambda x: list(zip(*(y.tolist() for y in x), strict=True))
    assert lists(periodic_runs.find_runs(data, start, end, index, first)) == want
    assert lists(periodic_runs.find_runs(data, start, end, index, first, pairs=3)) == want
    same = np.ones(len(start), np.uint64)  # hashes that tell no words apart
    assert lists(periodic_runs.find_runs(data, start, end, index, first, values=same)) == want


def test_runs_of_odd_rows_and_collapsing(spark):
    d = odd_docs(spark)
    got = periodic_runs.digests(d)
    assert got.count() == d.count() and periodic_runs.digests(d.limit(0)).count() == 0
    long = {r.doc_id: (r.start, r.length, r.period) for r in periodic_runs.runs_of(d).collect()}
    assert long == {3: (0, 60_000, 1)}
    out = periodic_runs.collapsed(d)
    assert out.columns == d.columns and {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in d.collect()} | {3: "wort"}


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's algorithm by plain loops: (codes, errors, codebooks)."""
    rows = sorted(rows)
    width = len(rows[0][1]) // parts
    x = [[tuple(int(np.floor(4096 * c)) for c in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v in rows]
    books = [[x[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda a, p: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        got = [[near(v[p], p) for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [v[p] for v, g in zip(x, got, strict=True) if g[p] == e]:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    got = [[near(v[p], p) for p in range(parts)] for v in x]
    return [(i, "".join(f"{e:02x}" for e in g), sum(far(v[p], books[p][g[p]]) for p in range(parts))) for (i, _), v, g in zip(rows, x, got, strict=True)], books


KIND = "vec_id long, embedding array<float>, label int, code string, n int"


@pytest.mark.parametrize(("n", "entries", "rounds"), [(400, 16, 6), (90, 5, 9), (3, 16, 6), (1, 16, 2)])
def test_codes_by_brute_force(spark, n, entries, rounds):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(7, 12)) / 200
    rows = [(int(i), (centres[rng.integers(7)] + rng.normal(size=12) / 900).astype("float32").tolist()) for i in rng.permutation(n) * 3]
    rows += [(10**6 + i, rows[0][1]) for i in range(n // 4)]
    want, books = plain_codes(rows, 4, entries, rounds)
    got = vector_codes.codes(spark.createDataFrame([(i, v, i % 3, "x", 1) for i, v in rows], KIND), 4, entries, rounds).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    told = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    by = {k: sum(e for i, _, e in want if i % 3 == k) for k in range(3)}
    assert all(r.codebooks_sha256 == told and r.label_error == by[r.vec_id % 3] for r in got)


def test_heaps_scan_few_parts_again(spark):
    kept = vector_codes.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    *_, scanned = vector_codes.trained(kept, 64)
    assert len(scanned) == 7 and scanned[0] == 8 * kept.count() and scanned[-1] < scanned[1] < scanned[0]


def test_codes_agree_with_sql(spark, small):
    assert difference(vector_codes.op12(spark, small), vector_codes.ORACLES["op12_vector_codes"], small) == ""


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1e-5, -1e-5, 3.0, 4.0, 0.0, 9e9]
    rows = [(1, None, 1), (2, [nan] + good[1:], 1), (3, [inf] + good[1:], None), (4, [None] + good[1:], 1), (5, good, None), (5, good, None), (None, good[::-1], 2), (6, good[:4], 1), (7, [], 1), (8, [-x for x in good], None)]
    d = spark.createDataFrame([(*r, "c", 2) for r in rows], KIND)
    got = vector_codes.codes(d).collect()
    assert sorted((str(r.vec_id), r.error) for r in got) == sorted([("5", 0), ("5", 0), ("None", 0), ("8", 0)])
    assert vector_codes.codes(d.where("vec_id < 5")).count() == 0 and vector_codes.codes(d.limit(0)).count() == 0
    assert vector_codes.codes(d.where("vec_id = 6"), 4).count() == 1


def test_sums_of_hot_and_rare_labels(spark):
    d = spark.range(5000).select((F.when(F.col("id") < 2000, F.lit(None)).when(F.col("id") < 4000, 1).otherwise(F.col("id"))).alias("label"), F.col("id").alias("error"))
    got = {(r.label, r.label_error) for r in vector_codes.with_label_sums(d).collect()}
    assert got == {(None, sum(range(2000))), (1, sum(range(2000, 4000)))} | {(i, i) for i in range(4000, 5000)}


def shards_hold(rows, texts, shards):
    """Sizes, checksums, slots and even bytes, recomputed from the texts; returns shards by text and the mean of bytes."""
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, loads, where = {}, [0] * shards, {}
    by = {}
    for i, t in texts:
        by.setdefault(i, t or "")
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
        where.setdefault(by[r.doc_id], []).append(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(loads) / shards, max(w[1] for w in want)
    assert max(loads) <= max(mean * 1.04, largest + 8) and (largest > mean or min(loads) >= mean * 0.94), (min(loads), mean, max(loads))
    return where, mean


def cut_edges(where):
    """Pairs of equal texts in different shards: all pairs, and those cut."""
    pairs = sum(len(s) * (len(s) - 1) // 2 for s in where.values())
    return pairs, pairs - sum(s.count(x) * (s.count(x) - 1) // 2 for s in where.values() for x in set(s))


def test_shards_keep_groups_whole_and_even(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(900):
        t = " ".join(word() for _ in range(rng.randrange(5, 90)))
        texts += [t] * rng.choice([1, 1, 1, 1, 2, 3, 8, 20])
    texts += ["the hot text is here again " * 8] * (len(texts) // 2)
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    where, mean = shards_hold(shard_balance.assigned(d).collect(), texts, 24)
    hot = where.pop("the hot text is here again " * 8)
    assert len(set(hot)) <= 12  # it fills 6 by itself and starts in 24
    started = {t: [zlib.crc32(str(i).encode()) % 24 for i, x in texts if x == t] for t in where}
    assert cut_edges(started)[1] > 0.8 * cut_edges(started)[0] and cut_edges(where)[1] <= 0.05 * cut_edges(where)[0]


def test_shards_of_copies_only_and_of_a_giant(spark):
    texts = list(enumerate(["one text of some length"] * 500 + ["another text of the same kind"] * 700))
    where, _ = shards_hold(shard_balance.assigned(spark.createDataFrame(texts, "doc_id long, text string"), 6).collect(), texts, 6)
    scattered = {t: [i % 6 for i in range(len(s))] for t, s in where.items()}
    assert cut_edges(where)[1] < 0.97 * cut_edges(scattered)[1]  # two groups and nothing else: hardly a document can give way
    texts = [(0, "giant " * 5000), *((i, f"small text {i % 40}") for i in range(1, 300))]
    shards_hold(shard_balance.assigned(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect(), texts, 4)


def test_shards_of_the_table_and_reruns(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = shard_balance.assigned(d).collect()
    where, _ = shards_hold(got, [tuple(r) for r in d.collect()], 24)
    pairs, cut = cut_edges(where)
    assert pairs > 100 and cut <= 0.02 * pairs
    again = shard_balance.assigned(d.repartition(9, "text")).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_odd_rows_and_written_shards(spark, tmp_path):
    d = odd_docs(spark).withColumn("shard", F.lit("mine")).withColumn("k1", F.lit(1))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = shard_balance.assigned(d, 3).collect()
    assert len(got) == len(rows) and shard_balance.assigned(d.limit(0)).count() == 0
    shard_balance.write_shards(d, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*d.columns, "shard_"]) and back.count() == len(rows)
    assert back.groupBy("shard_").count().count() == len({r.shard for r in got})
    assert shard_balance.assigned(d, 2, group=F.col("source")).count() == len(rows)


def test_level_of_loads():
    assert shard_balance.level_of([5, 1, 3], 3) == 3.5 and shard_balance.level_of([5, 1, 3], 6) == 5 and shard_balance.level_of([9, 0], 2) == 2
