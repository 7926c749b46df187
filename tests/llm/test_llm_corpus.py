"""Mixing, near-duplicates, token output, decontamination, media and the pipeline: against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import decontaminate, media_sequences, simhash, source_mix, token_planes
from oracle import difference
from test_llm_text_models import odd_docs


def test_mix_agrees_with_sql(spark):
    assert difference(source_mix.op3(spark, "/root/testdata/sf0.01"), source_mix.SQL, "/root/testdata/sf0.01") == ""


def test_mix_meets_targets_and_reruns_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    a = source_mix.mix(d).toPandas()
    assert (a.taken <= 2 * a["size"]).all()
    by = a.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 50).all() and by.target.sum() == pytest.approx(1.5 * a["size"].sum(), rel=1e-6)
    b = source_mix.mix(d.repartition(7, "text")).toPandas()
    assert dict(zip(a.doc_id, a.taken)) == dict(zip(b.doc_id, b.taken))


def test_mix_of_odd_rows(spark):
    d = odd_docs(spark)
    got = source_mix.mix(d)
    assert got.count() == d.count() and got.where("taken is null or taken > 2 * size").count() == 0
    assert source_mix.mix(d.limit(0)).count() == 0
    assert source_mix.mixed_documents(d).columns == d.columns


def test_mix_ignores_clashing_columns(spark):
    d = spark.createDataFrame([(i, f"s{i % 3}", "word " * (i + 1), 7, 7, "x") for i in range(50)], "doc_id long, source string, text string, _row long, size long, u string")
    got = source_mix.mix(d)
    assert got.count() == 50 and got.where("taken > 2 * size").count() == 0
    assert source_mix.mixed_documents(d).columns == d.columns


def plain_print(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split() if text.isascii() else text.split()
    if not low:
        return 0
    grams = [" ".join(low[i : i + n]) for i in range(max(1, len(low) - n + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_fingerprints_and_components_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "One two", "one TWO"] + [" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    got = simhash.near_duplicates(spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    prints = {i + 10: plain_print(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in ids}


def test_fingerprints_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2), (5, "a b c d", 3), (6, None, 4), (7, "", 5)], "doc_id long, text string, node int").withColumn("fingerprint", F.lit("x")).withColumn("w0", F.lit(0))
    got = simhash.near_duplicates(d).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 5), (0, 5), (5, 5), (6, 6), (7, 6)]
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_parity_bits_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(2)
    for n, m, both in ((100, 120, 98), (60, 70, 58), (5, 5, 5), (500, 620, 498), (1, 1, 1)):
        pool = rng.integers(0, 1 << 63, n + m, np.uint64)
        sets = [np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : n + m - both]])]
        ends, words = simhash.parity(np.repeat([0, 1], [n, m]), np.concatenate(sets), np.array([n, m]))
        a, b = words[: ends[0]].view(np.uint64), words[ends[0] : ends[1]].view(np.uint64)
        while len(a) != len(b):
            a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
        assert np.bitwise_count(a ^ b).sum() <= n + m - 2 * both


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    nodes = {base} | {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [n - (1 << 64) if n >> 63 else n for n in nodes]
    df = spark.createDataFrame([(n, n) for n in signed], "node long, w0 long")
    label = {r.node: r.label for r in simhash.components(simhash.links(df, 1, simhash.exact_tables(2), 2, exact=True)).collect()}
    near = [n for n in signed if bin((n & (1 << 64) - 1) ^ base).count("1") <= 2]
    assert len({label[n] for n in near}) == 1


def test_one_of_each_group_stays(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, kept = [], set()
    for g in range(40):
        text = [word() for _ in range(200)]
        kept.add(g * 100)
        for k in range(1 + g % 15):
            t = list(text)
            for _ in range(min(k, 3)):
                t[rng.randrange(200)] = word()
            rows.append((g * 100 + k, " ".join(t), "en"))
    rows += [(0, rows[0][1], "en"), (0, rows[0][1], "de"), (None, rows[0][1], "en"), (9_001, None, "en"), (9_002, "", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("extra"))
    got = simhash.keep_one(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r.lang) for r in got.collect()) == sorted((i, "de" if i == 0 else "en") for i in kept | {9_001})
    assert simhash.keep_one(d.limit(0)).count() == 0
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.lang) for r in simhash.keep_one(d).collect()) == sorted((i, "de" if i == 0 else "en") for i in kept | {9_001})


def kept_by_brute_force(texts, similarity=0.8, n=5):
    """Indices of the texts that stay: the first of each group of shingle sets linked at similarity or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c >= similarity * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in range(len(texts)) if root[i] == i}


def template_families():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for share in (60, 75, 84, 88, 90, 92):  # words of a family's template, of 100
        template = [word() for _ in range(share)]
        pools = [[word() for _ in range(5)] for _ in range(3)]
        for _ in range(45):
            own = [word() for _ in range(100 - share)]
            texts.append(template + own)
            if rng.random() < 0.4:  # a near copy: its last words differ
                k = rng.randrange(1, 25)
                texts.append(template + own[: max(0, len(own) - k)] + [word() for _ in range(min(k, len(own)))])
        for _ in range(45):  # only shared passages, in many mixtures
            texts.append(template[:50] + [w for _ in range(6) for w in rng.choice(pools)])
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_template_families_lose_no_link(spark, monkeypatch):
    texts = template_families()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept_by_brute_force(texts)
    assert {r.doc_id for r in simhash.keep_one(d).select("doc_id").collect()} == want
    for crowded, block, hot in ((1, 3, 0), (4, 7, 50)):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "HOT", hot)
        assert {r.doc_id for r in simhash.keep_one(d).select("doc_id").collect()} == want


def test_pairs_inside_a_crowded_family_stay_linked(spark):
    template = " ".join(f"t{k}" for k in range(75))
    rows = []
    for i in range(1_000):  # members are similar at 0.59; the two of a pair at 0.81
        own = [f"{i}w{k}" for k in range(25)]
        rows += [(2 * i, " ".join([template, *own])), (2 * i + 1, " ".join([template, *own[:15], *(f"{i}v{k}" for k in range(10))]))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(0, 2_000, 2))


def test_copies_of_one_text_are_not_paired_out(spark, monkeypatch):
    rng = random.Random(3)
    base, texts = [f"b{k}" for k in range(150)], []
    for i in range(300):  # two or three words changed: most pairs are under 0.8, those with changes side by side at 0.8 and more
        t = list(base)
        for k in rng.sample(range(150), rng.randint(2, 3)):
            t[k] = f"x{i}n{k}"
        texts.append(" ".join(t))
    monkeypatch.setattr(simhash, "FRUITFUL", 1e9)  # to the last round at once
    judged, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda likely, *a: (judged.append(likely.count()), similar(likely, *a))[1])
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in got.select("doc_id").collect()} == kept_by_brute_force(texts)
    assert sum(judged) <= 16 * len(texts), judged  # of 44,850 pairs


def test_near_duplicates_come_through_fingerprints_first(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(60):  # one of 300 words changed: a few bits differ
        t = [f"{i}w{k}" for k in range(300)]
        rows.append((2 * i, " ".join(t)))
        t[rng.randrange(300)] = "other"
        rows.append((2 * i + 1, " ".join(t)))
    found, prints = [], simhash.print_pairs
    monkeypatch.setattr(simhash, "print_pairs", lambda nodes: (out := prints(nodes), found.append(out.count()))[0])
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(0, 120, 2))
    assert found and 40 <= found[0] <= 60  # most pairs meet in the pivot tables


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(500 + rng.randrange(60), 600 + k) for k in range(60)] + [(777, 700 + k) for k in range(150) if k != 77]
    names = rng.sample(range(10_000), 900)
    edges = [(names[a], names[b]) for a, b in edges]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in simhash.components(frame).collect()} == {x: top(x) for x in root}
    first = simhash.components(frame.limit(230))
    both = simhash._linked(first, frame.subtract(frame.limit(230)))
    assert {r.node: r.label for r in both.collect()} == {x: top(x) for x in root}
    assert simhash.components(frame.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found_in_a_large_table(spark):
    rows = []
    for i in range(15_000):  # 13 words make 9 shingles; one word more or less at the end leaves 8 of 10 in common
        t = [f"{i}x{k}" for k in range(12)]
        rows += [(2 * i, " ".join([*t, f"{i}y"])), (2 * i + 1, " ".join([*t, f"{i}z"]))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 15_000 and got.where("doc_id % 2 = 1").count() == 0


def test_tokens_are_those_of_whole_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None), (-4, ""), (-3, "<|endoftext|> x<|endoftext|>y"), (-2, "\x01 a\x01b é ΟΔΟΣ it's 12 --- 😀"), (-1, "word " * 300_000)], "doc_id long, text string"))
    got = token_planes.read_shards(token_planes.write_shards(d, shard_ids=5_000, block=1_000)).orderBy("doc_id").collect()
    coder = token_planes.Encoder().model
    at = 0
    for r, (i, text) in zip(got, sorted(map(tuple, d.collect())), strict=True):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, token_planes.END_ID], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_planes.read_shards(token_planes.write_shards(d.limit(0))).count() == 0


def test_tokens_of_repeated_and_null_ids_are_parted(spark):
    rows = [(None, "a b c")] * 300 + [(7, f"word {k % 3}") for k in range(300)] + [(9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("extra")).withColumn("h", F.lit(1.5))
    shards = token_planes.write_shards(d, part_bytes=300)
    assert shards.select("part").distinct().count() > 4
    got = sorted(token_planes.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [7] * 300 + [9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    coder = token_planes.Encoder().model
    want = sorted(zlib.crc32(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want


def test_planes_round_trip():
    for top in (1, 40_000, 1 << 20):
        ids = np.random.default_rng(1).integers(0, top, 3_001).astype(np.uint32)
        counts = np.array([1, 0, 3_000])
        a, b = token_planes.unpack(token_planes.pack(ids, counts, 256))
        assert (a == ids).all() and (b == counts).all()


def plain_distance(item, text):
    """Least edits to turn item into a stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_items_by_edit_distance(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["ka", "lo", "mi", "nu", "po", "ra"]) + rng.choice(["x", "y", "z"])
    items = [(i, [word() for _ in range(rng.randrange(2, 30))]) for i in range(12)]
    docs = []
    for d in range(40):
        t = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            item = list(items[d % 12][1])
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(item) + 1)
                item[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            at = rng.randrange(len(t) + 1)
            t[at:at] = item
        docs.append((d, t))
    D = spark.createDataFrame([(d, " ".join(t).title() + "!") for d, t in docs] + [(None, "nothing"), (50, None)], "doc_id long, text string")
    B = spark.createDataFrame([(i, ", ".join(t)) for i, t in items] + [(99, None)], "item_id long, text string")
    want = {(d, i, plain_distance(x, t)) for d, t in docs for i, x in items if len(x) >= 3 and plain_distance(x, t) <= int(len(x) * decontaminate.RATE)}
    for block in (40, 1_000_000):
        got = decontaminate.contaminated(D, B, block_terms=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    clean = {r.doc_id for r in decontaminate.without_items(D.withColumn("item_id", F.lit(1)), B).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _, _ in want} | {None, 50}
    assert decontaminate.contaminated(D.limit(0), B).count() == 0 and decontaminate.contaminated(D, B.limit(0)).count() == 0


def test_short_texts_against_longer_pieces(spark):
    items = spark.createDataFrame([(1, "ka lo mi nu po"), (2, " ".join(f"w{k}" for k in range(24)))], "item_id long, text string")  # pieces of 2, 3, 4 and 5 terms
    for n in range(8):
        d = spark.createDataFrame([(n, " ".join("ka lo mi nu po ra sa ta".split()[:n]))], "doc_id long, text string").coalesce(1)
        assert [(r.item_id, r.distance) for r in decontaminate.contaminated(d, items).collect()] == ([(1, max(0, 5 - n))] if n >= 4 else [])
        assert decontaminate.without_items(d, items).count() == (0 if n >= 4 else 1)


def test_media_read_back(spark):
    texts = [None, "", "short", "x" * 192, "é😀 <b>&amp;</b> \"q\"" * 50, "word " * 100_000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string")
    held = media_sequences.document_media(d)
    page = media_sequences.resolve(media_sequences.parse_sequences(held.select("page_id", "html")), media_sequences.media_features(held))
    got = {r.page_id: r for r in page.where("kind = 'media'").collect()}
    for i, t in enumerate([*texts, texts[2]]):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.caption == f"Text of document {i}"
    assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256
    whole = {r.page_id: [x.kind for x in r.sequence] for r in media_sequences.interleave(page).collect()}
    assert whole[0] == ["text", "media"]


def test_sequences_keep_order_and_lost_media(spark):
    html = '<body><p>One</p><figure><img src="media:aa" alt="x"><figcaption>Cap &amp; tion</figcaption></figure><p>Two <b>three</b></p><img src="media:zz" alt="alt"><script>no</script></body>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    media = spark.createDataFrame([("aa", 5)], "digest string, media_bytes long")
    got = media_sequences.interleave(media_sequences.resolve(media_sequences.parse_sequences(pages), media)).collect()
    assert [[(x.kind, x.text, x.digest, x.caption, x.media_bytes) for x in r.sequence] for r in got] == [[("text", "One", None, None, None), ("media", None, "aa", "Cap & tion", 5), ("text", "Two three", None, None, None), ("media", None, "zz", "alt", None)]]


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>t</title><body><p>kept</p>", [("text", "kept", None)]),
    ("<head><meta charset=x><p>no body tag</p>", [("text", "no body tag", None)]),
    ('<figure><img src="media:a"><figcaption>cap</figure><p>after</p>', [("media", "a", "cap"), ("text", "after", None)]),
    ('<img src="media:a" alt="old"><figcaption>loose</figcaption><p>x</p>', [("media", "a", "old"), ("text", "loose", None), ("text", "x", None)]),
    ('<figure><img src="media:a"><figure><img src="media:b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>', [("media", "a", "out"), ("media", "b", "in")]),
    ('<figure><img src="media:a"><figcaption>never closed <p>still here</p>', [("media", "a", None), ("text", "never closed still here", None)]),
    ('<div><nav>menu</div><p>text</p>', [("text", "text", None)]),
    ('<nav>menu<article><p>story</p></article>', [("text", "story", None)]),
    ("a</p>b<br>c</div></section>d", [("text", "ab", None), ("text", "cd", None)]),
    ("<script>x<p>y</script><style>z", []),
])
def test_broken_markup_loses_nothing(html, want):
    assert [(k, t or d, c) for k, t, d, c, _ in media_sequences.elements(html)] == want


def test_odd_sizes_of_media():
    for size, want in (("12", 12), ("\u00b2", None), ("9" * 30, None), ("-1", None), ("", None)):
        assert media_sequences.elements(f'<img src="media:a" data-bytes="{size}">')[0][4] == want


def test_pages_become_sequences_in_order(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = media_sequences.interleave(media_sequences.parse_sequences(pages)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert {r.page_id: [(x.kind, x.text, x.digest) for x in r.sequence] for r in got} == {k: e for k, h in html.items() if (e := [(a, t, d) for a, t, d, _, _ in media_sequences.elements(h)])}
    assert all([x.position for x in r.sequence] == list(range(len(r.sequence))) for r in got)


def test_media_of_crowded_payloads_and_odd_rows(spark):
    rows = [(None, None, "a", 1)] * 20 + [(3, "same", "a", None)] * 30 + [(k, f"text {k}", None, 2) for k in range(10)]
    held = media_sequences.document_media(spark.createDataFrame(rows, "doc_id long, text string, html string, digest int"))
    for hot, most in ((5, 100), (5, 0), (1_000, 100)):
        got = media_sequences.document_sequences(held, hot, most).collect()
        assert len(got) == len(rows) and sorted((r.page_id or -1) for r in got) == sorted((r[0] or -1) for r in rows)
        assert all([x.kind for x in r.sequence] == ["text", "media"] and r.sequence[1].payload_bytes == 192 for r in got)
        assert {r.sequence[0].text for r in got} == {f"Document {r[0]}" for r in rows}
    empty = media_sequences.document_media(spark.createDataFrame([], "doc_id long, text string"))
    assert media_sequences.document_sequences(empty).count() == 0


def test_pipeline_stages_on_whole_tables(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, small)
        assert out.columns == d.columns and ids(out) <= ids(d), name
        d = out if name != "mixing" else d
    kept = corpus_pipeline.benchmark_out(spark, d, small)
    held = decontaminate.contaminated(kept, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert held.count() == 0
    out = corpus_pipeline.run(spark, small).orderBy("start").collect()
    assert out and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
