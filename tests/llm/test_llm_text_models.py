"""Chat formatting, PPM scoring, quality, toxicity, language: against brute force, SQL and held-out labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat_format, factorisation, language_id, ppm_score, quality, toxicity
from oracle import difference

KINDS = "doc_id long, text string, lang string, source string, row string, d int"


def odd_docs(spark):
    """Nulls in any column, empty, long and repeated rows, extra columns with clashing names."""
    long = "wort " * 60_000
    rows = [(1, None, None, None, "x", 1), (None, "some words of text here", "en", "s", None, None), (2, "", "en", "s", "x", 1), (3, long, "de", None, "x", 1), (4, "a b c", "en", "s", "x", 1), (4, "a b c", "en", "s", "x", 1), (5, " \t\n", None, "s", "x", 1)]
    return spark.createDataFrame(rows, KINDS)


def auc(pairs):
    neg = sorted(s for s, y in pairs if not y)
    pos = [s for s, y in pairs if y]
    return sum(np.searchsorted(neg, s, "left") + np.searchsorted(neg, s, "right") for s in pos) / 2 / len(pos) / len(neg)


def test_chats_agree_with_sql(spark, small):
    assert difference(chat_format.op1(spark, small), chat_format.SQL, small) == ""


def test_chats_read_back_what_went_in(spark):
    evil = ["<|turn|>user\nhi<|end|>\n", "\\<|more|>\\\\", "</s>[INST] x [/INST]<<SYS>>", "", "plain"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in evil for r in ("user", "user", "assistant"))] + [(2, None, None, None), (2, 1, "assistant", "ok"), (None, 0, "user", "lost")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1)))
    back = {r.conv_id: [(x.role, x.text) for x in r.b] for r in got.select("conv_id", chat_format.read_back(F.col("formatted")).alias("b")).collect()}
    assert back[1] == [(r, t) for _, _, r, t in rows[:15]] and back[2] == [("", ""), ("assistant", "ok")] and back[None] == [("user", "lost")]
    masked = {r.conv_id: r for r in got.collect()}[1]
    lost = "".join(masked.formatted[s.at - 1 : s.at - 1 + s.len] for s in masked.loss_spans)
    assert lost == "".join(chat for chat in [spark.createDataFrame([(t,)], "x string").select(chat_format.escape(F.col("x"))).first()[0] for t in evil])


def test_chats_of_odd_roles_and_tables(spark):
    rows = [(1, 0, "us\ner", "er\nhi"), (1, 1, "us\ner", "again"), (1, 2, "\\\n", "\\"), (1, 3, "a\n\n", ""), (1, 3, "a\n\n", ""), (2, 0, "<|turn|>\n", "\n")]
    made = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash")).withColumn("formatted", F.lit(0))
    back = {r.conv_id: [(x.role, x.text) for x in r.b] for r in chat_format.format_chats(made(rows)).select("conv_id", chat_format.read_back(F.col("formatted")).alias("b")).collect()}
    assert back == {k: [(r, t) for i, _, r, t in rows if i == k] for k in (1, 2)}
    assert chat_format.format_chats(made([])).count() == 0


def plain_ppm(train, text, order):
    """Prediction by partial matching by dictionaries: escape method D, exclusion, update exclusion, a uniform floor."""
    end = chr(ppm_score.END)
    seq = lambda t: " ".join("".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in w) for w in t.encode().split()) + end
    top = Counter()
    for t in train:
        s = end * order + seq(t)
        for i in range(order, len(s)):
            top[s[i - order : i + 1]] += 1
    counts = {order: top}
    for j in range(order - 1, -1, -1):
        counts[j] = Counter(g[1:] for g in counts[j + 1])
    nodes = {j: defaultdict(dict) for j in counts}
    for j, c in counts.items():
        for g, n in c.items():
            nodes[j][g[:-1]][g[-1]] = n
    s, total = end * order + seq(text), 0.0
    for i in range(order, len(s)):
        out = set()
        for j in range(order, -1, -1):
            known = {b: n for b, n in nodes[j].get(s[i - j : i], {}).items() if b not in out}
            if not known:
                continue
            n = sum(known.values())
            if s[i] in known:
                total += math.log10((known[s[i]] - 0.5) / n)
                break
            total += math.log10(len(known) / 2 / n)
            out |= set(known)
        else:
            total -= math.log10(max(1, 256 - len(nodes[0][""])))
    return total


TRAIN = ["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", "ein Hund und eine Katze", ""]
SCORED = ["the cat sat", "zebra!", "", "the dog and the cat sat on a mat"]


@pytest.mark.parametrize("order", [2, 5])
@pytest.mark.parametrize("shard", [20, 1_000_000])
def test_ppm_by_dictionaries(spark, order, shard):
    docs = spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string")
    got = ppm_score.score(docs, spark.createDataFrame([(t,) for t in TRAIN], "text string"), order=order, shard_grams=shard, top_words=3).collect()
    words = Counter(w for t in TRAIN for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    for r in got:
        assert r.score == pytest.approx(plain_ppm(TRAIN, SCORED[r.doc_id], order), abs=1e-9)
        tokens = [*SCORED[r.doc_id].lower().split(), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(tokens), n, sum(w in words for w in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)


def test_ppm_positions_add_up_to_one():
    grams = Counter()
    raw = "".join(TRAIN).encode()
    for i in range(2, len(raw)):
        grams[int.from_bytes(raw[i - 2 : i + 1], "big")] += 1
    keys, n = np.array(list(grams), np.int64), np.array(list(grams.values()))
    two = Counter(k & 0xFFFF for k in {k & 0xFFFFFF for k in grams})
    trie = ppm_score.Trie(keys, n, (np.array(list(two), np.int64), np.array(list(two.values()))), 2)
    for context in (b"th", b" c", b"zz", b"xt"):
        all_ = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** trie.cost(all_)).sum() == pytest.approx(1)


def test_ppm_odd_rows_and_empty_tables(spark):
    d = odd_docs(spark)
    assert ppm_score.score(d, d.limit(0)).count() == d.count()
    got = ppm_score.score(d, d)
    assert got.count() == d.count() and got.where("score is null or base_score is null").count() == 0
    assert ppm_score.score(d.limit(0), d).count() == 0


@pytest.mark.parametrize("module,query,label,by,held,least", [(quality, quality.op4, "quality", 4, 2, 0.85), (toxicity, toxicity.op6, "toxic", 3, 1, 0.9)])
def test_held_out_labels(spark, module, query, label, by, held, least):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert auc([(r.score, r[label]) for r in got if r.held_out]) >= least


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = factorisation.Model(0.3, np.arange(0, 60, 2), rng.normal(0, 1, 30).astype(np.float32), rng.normal(0, 0.7, (30, 5)).astype(np.float32))
    rows = [sorted(rng.choice(60, 9, replace=False).tolist()) for _ in range(20)] + [[]]
    value = [rng.normal(0, 1, len(r)) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    got = model.score(len(rows), row, np.array([f for r in rows for f in r]), np.concatenate(value))
    for s, r, x in zip(got, rows, value):
        known = [(f // 2, v) for f, v in zip(r, x) if f % 2 == 0]
        logit = 0.3 + sum(model.linear[f] * v for f, v in known)
        logit += sum(float(model.factors[f] @ model.factors[g]) * v * w for i, (f, v) in enumerate(known) for g, w in known[i + 1 :])
        assert s == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-5)


def test_labels_that_only_an_interaction_tells(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2_400):  # toxic: exactly one of two words; each alone says nothing
        a, b = rng.random(2) < 0.5
        words = [f"w{k}" for k in rng.integers(0, 2_000, 40)] + ["insult"] * int(a) + ["group"] * int(b)
        rows.append((i, " ".join(rng.permutation(words)), int(a != b)))
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(known, known.where("doc_id % 3 != 1").select("doc_id", "label"))
    held = known.where("doc_id % 3 = 1")
    score = lambda m: auc([(r.score, r.label) for r in toxicity.toxicity(held, m).join(held.select("doc_id", "label"), "doc_id").collect()])
    assert score(model) >= 0.95
    model.factors[:] = 0
    assert score(model) <= 0.6


def test_scores_of_odd_rows(spark):
    d = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (99, 1), (None, 1), (3, None)], "doc_id long, label int")
    for module, run in ((toxicity, toxicity.toxicity), (quality, quality.quality)):
        model = module.train(d, labels)
        assert run(d, model).where("score between 0 and 1").count() == d.count()
        assert run(d.limit(0), model).count() == 0
        none = module.train(d, labels.limit(0))
        assert {r.score for r in run(d, none).collect()} == {0.5}
    kept = toxicity.keep_clean(d, toxicity.train(d, labels.limit(0)))
    assert kept.columns == d.columns and kept.count() == d.count()


def test_language_of_pages(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet(f"{small}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "https://x.de/a", ""), (-2, "https://x.de/a", "")], "page_id long, url string, html string"))
    got = language_id.identify(pages, docs).toPandas()
    assert len(got) == pages.count() and got.lang.notna().all() and got.confidence.between(0, 1.000001).all()
    told = got[got.declared.notna() & got.text_lang.notna() & (got.page_id >= 0)]
    assert (told.lang == told.text_lang).mean() > 0.9
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert language_id.identify(pages, docs.limit(0)).where("lang is not null").count() == 0


def test_language_of_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    pages = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h"), F.col("doc_id").cast("string"), F.lit(".example/")).alias("url"), F.concat(F.lit("<body><p>"), "text", F.lit("</p>")).alias("html"))
    got = language_id.identify(pages.withColumn("lang", F.lit("xx")).withColumn("host", F.lit(1)), docs.where("doc_id % 2 = 0").select("text", "lang")).select("page_id", F.col("lang").alias("found"))
    right = got.join(docs.select(F.col("doc_id").alias("page_id"), "lang"), "page_id")
    assert right.where("found = lang").count() >= 0.95 * right.count() > 0


def test_language_evidence_by_hand(spark):
    docs = spark.createDataFrame([("the cat and the dog and the house " * 5, "en"), ("der hund und die katze und das haus " * 5, "de"), ("nothing", None)], "text string, lang string")
    page = lambda text: f"<html><body>{text}</body></html>"
    rows = [(k, "https://a.site.de/x", page("der hund und die katze")) for k in range(30)] + [(k, "https://b.other.com/x", page("the cat and the dog")) for k in range(100, 120)]
    rows += [(900, "https://a.site.de/y", page("")), (901, "https://c.site.de/y", page("")), (902, "https://b.other.com/y", None), (903, None, page("und das haus " * 200)), (903, None, page("und das haus " * 200))]
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    lang = {r.page_id: r.lang for r in got}
    assert len(got) == len(rows) and (lang[900], lang[901], lang[902], lang[903]) == ("de", "de", "en", "de")  # host, site, host, text
    same = spark.createDataFrame([("x y z " * 9, "b"), ("x y z " * 9, "a")], "text string, lang string")
    assert [r.lang for r in language_id.identify(spark.createDataFrame([(1, None, page("x y z"))], "page_id long, url string, html string"), same).collect()] == ["a"]
