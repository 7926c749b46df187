"""Operators against hand-made cases and plain Python forms; invariants of spans, masks and shares."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import citations as C
from inkwell.operators import corpora as K
from inkwell.operators import detector as D
from inkwell.operators import grammar as G
from inkwell.operators import integrity as I
from inkwell.operators import overlap as O
from inkwell.operators import pictures as X
from inkwell.operators import preparing as P
from inkwell.operators import rewriting as R
from inkwell.operators import statistics as S
from inkwell.operators.tokens import token_spans
from inkwell.sources import library as L
from inkwell.sources import markup as M


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_token_spans_are_substrings(spark):
    text = "Well-known “facts” aren't 3 things; l’été!"
    for r in token_spans(docs(spark, text, "", None)).collect():
        assert text[r.start : r.end] == r.raw


def test_exact_sentences_look_back(spark):
    got = one(spark, P.exact_sentences, "We saw Dr. Smith et al. (2020) in Fig. 3. J. Doe agrees, etc. He left. it goes on.")
    assert got == ["We saw Dr. Smith et al. (2020) in Fig. 3.", "J. Doe agrees, etc.", "He left. it goes on."]


def test_masks_keep_length_and_restore(spark):
    text = "See $a+b$ and [1, 2] (Smith, 2020) at https://x.org/y now; Figure 3 too."
    row = spark.createDataFrame([(text,)], "x string").select(P.masked(F.col("x")).alias("m"), P.with_placeholders(F.col("x")).alias("p"), T.matches(F.col("x"), P.ANY_PROTECTED).alias("s")).first()
    assert len(row.m) == len(text) and all(a == b or a == P.MASK for a, b in zip(row.m, text))
    back = spark.createDataFrame([(row.p, row.s)], "p string, s array<string>").select(P.restored(F.col("p"), F.col("s")).alias("r")).first().r
    assert back.text == text and not back.missing and not back.duplicated and not back.unknown


def test_packed_like_a_loop(spark):
    rng = random.Random(3)

    def plain(xs, least, tail):
        out, first, total = [], 1, 0
        for i, x in enumerate(xs, 1):
            total += x
            if total >= least:
                out.append([first, i, total])
                first, total = i + 1, 0
        if total:
            if out and total < tail:
                out[-1][1], out[-1][2] = len(xs), out[-1][2] + total
            else:
                out.append([first, len(xs), total])
        return out

    cases = [[rng.randrange(0, 90) for _ in range(rng.randrange(0, 12))] for _ in range(40)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>").select("i", P.packed(F.col("c"), 100, 60).alias("p")).orderBy("i").collect()
    assert [[list(x) for x in r.p] for r in got] == [plain(c, 100, 60) for c in cases]


def test_moving_ratio_by_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (0, 1, 49, 50, 51, 130)]
    got = {r.doc_id: r.mattr for r in S.moving_type_token_ratio(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            windows = [w[k : k + 50] for k in range(max(1, len(w) - 49))]
            assert got[i] == pytest.approx(sum(len(set(x)) / len(x) for x in windows) / len(windows), abs=1e-6)
    assert 0 not in got


def test_runs_bridge_small_edits(spark):
    source = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    body = "before " + source.replace("theta", "changed") + " after"
    d, s = docs(spark, body), spark.createDataFrame([(7, source)], "source_id long, text string")
    exact = O.accepted(O.exact_runs(O.seed_hits(d, s)), d).collect()
    assert sorted((r.start, r.words) for r in exact) == [(1, 7), (9, 8)]
    bridged = O.bridged_runs(O.seed_hits(d, s), d).collect()
    assert [(r.start, r.end, r.words) for r in bridged] == [(1, 17, 15)]


def test_credit_adds_up_to_the_covered_words(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    s = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("source_id"), "text")
    runs = O.accepted(O.exact_runs(O.seed_hits(d, s)), d).cache()
    spans = O.credited_spans(runs, s.withColumn("year", F.lit(None).cast("int")))
    a = {r.doc_id: r.n for r in spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    b = {r.doc_id: r.matched for r in O.similarity(d, runs).where("matched > 0").collect()}
    assert a == b and a


def test_paraphrase_needs_concepts(spark):
    a = spark.createDataFrame([(1, 0, "The method increases accuracy on large image datasets for medical experts."), (2, 0, "Rain fell on the hills all night long.")], "doc_id long, ix int, text string")
    b = spark.createDataFrame([(9, 0, "For medical experts, the technique boosts accuracy on big image datasets.")], "source_id long, ix int, text string")
    assert [(r.doc_id, r.source_id) for r in O.paraphrases(a, b).collect()] == [(1, 9)]


def test_hash_of_the_empty_string(spark):
    assert one(spark, T.fnv18, "") == 0x811C9DC5 & 0x3FFFF


def test_features_have_unit_length_and_ignore_disguise(spark):
    plain, odd = "the cat sat on the mat", "thе cat sаt on the mat"
    f = D.hashed_features(docs(spark, plain, odd).withColumn("text", I.clean(F.col("text"))))
    g = {r.doc_id: sorted((x.h, x.value) for x in r.f) for r in f.groupBy("doc_id").agg(F.collect_list(F.struct("h", "value")).alias("f")).collect()}
    assert g[0] == g[1] and sum(v * v for _, v in g[0]) == pytest.approx(1)


def test_breakdown_shares_add_up(spark):
    t = spark.createDataFrame([(1, p, p // 50) for p in range(400)], "doc_id long, pos int, block int")
    parts = spark.createDataFrame([(1, 0, 199, 200, 0.95), (1, 200, 399, 200, 0.1)], "doc_id long, first int, last int, words int, probability double")
    r = D.breakdown(t, parts).first()
    assert (r.ai_percent, r.human_percent, r.uncertain_percent, r.ai_passages) == (50.0, 50.0, 0.0, 4)


def test_percentiles_rise(spark):
    q = [0.05, 0.08, 0.12, 0.2, 0.35, 0.5, 0.7, 0.8, 0.88]
    d = spark.createDataFrame([(x / 200,) for x in range(201)], "p double").select("p", D.human_percentile(F.col("p"), F.array(*[F.lit(x) for x in q])).alias("h"), D.classifier_scale(F.col("p"), F.array(*[F.lit(x) for x in q])).alias("c")).orderBy("p").collect()
    for k in ("h", "c"):
        xs = [r[k] for r in d]
        assert xs == sorted(xs) and 0 <= xs[0] and xs[-1] <= 1


def test_grammar_fixes_by_hand(spark):
    text = docs(spark, "He saw a apple and an book, and and an hour later a SVM, a one.")
    issues = G.articles(text).unionByName(G.repeated_words(text))
    fixed = G.apply_fixes(text, issues.select("doc_id", "start", "end", "suggestion")).first()
    assert fixed.text == "He saw an apple and a book, and an hour later an SVM, a one." and fixed.applied == 4


def test_tricks_merge_and_spare_real_greek(spark):
    got = I.tricks(docs(spark, "Thе dаta in thіs study", "Η γλώσσα αυτή είναι ελληνική και μόνο", "plain")).collect()
    assert [(r.doc_id, r.kind, r["count"]) for r in got] == [(0, "lookalike_letters", 3)]


def test_reference_list_by_names_and_hyphens(spark):
    got = C.split_references(docs(spark, "Adams, D. (1979). One en-\ntry. Pan.\nClarke, A. (1968). Another.")).orderBy("index").collect()
    assert [r.raw for r in got] == ["Adams, D. (1979). One entry. Pan.", "Clarke, A. (1968). Another."]


def test_best_match_and_duplicates(spark, small):
    from inkwell.plans import citing

    m = {r.ref_id: (r.work_id, r.status) for r in citing.j14(spark, small).collect()}
    assert m[101] == (1, "verified") and m[102][0] == 2
    d = {(r.ref_id, r.duplicate_of) for r in citing.c24(spark, small).collect()}
    assert {(11, 1), (12, 2), (13, 3)} <= d


def test_ranked_works_drop_the_retracted(spark, small):
    from inkwell.plans import citing

    got = [(r.doc_id, r.work_id) for r in citing.c28(spark, small).collect()]
    assert (2, 1) in got and (1, 5) in got and (1, 4) not in got


def test_quality_of_plain_and_padded(spark):
    plain = "We slept badly. The cat, which was old and loud, kept us up until 3 am on Monday! Then it rained in Paris."
    padded = "It is important to note that we utilise a plethora of multifaceted frameworks. Moreover, we leverage a myriad of holistic approaches. Furthermore, this plays a crucial role in the realm of research."
    a, b = (r.score for r in R.writing_quality(docs(spark, plain, padded)).orderBy("doc_id").collect())
    assert a > b + 20


def test_diff_like_a_table(spark):
    import difflib  # noqa: F401

    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(12))), " ".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for i in range(30)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    long = " ".join(f"w{i}" for i in range(9000))
    pairs += [(30, long, " ".join(f"w{i}" for i in range(9000) if i % 9)), (31, None, "a b"), (32, "", None), (33, "a a a", "a")]
    exact = {30: 8000, 31: 0, 32: 0, 33: 1}
    got = {r.id: r.kept for r in R.diff_share(spark.createDataFrame(pairs, "id long, before string, after string")).collect()}
    assert got == {i: lcs(a.split(), b.split()) for i, a, b in pairs if i not in exact} | exact


def test_sample_takes_the_least_hashes(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = K.stratified_sample(spark.createDataFrame(rows, "id long, s string"), ["s"], 50, "id", bins=64).collect()
    import hashlib

    h = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16), i)
    for s in {s for _, s in rows}:
        assert sorted(r.id for r in got if r.s == s) == sorted(sorted((i for i, x in rows if x == s), key=h)[:50])


def test_training_separates(spark):
    texts = [f"good clear prose number {i} with plain facts" if i % 2 else f"buy cheap pills now offer {i} click click" for i in range(60)]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    f = D.hashed_features(d)
    w, bias = K.train(f, labels)
    p = {r.doc_id: r.probability for r in D.model_probability(f, w, bias).collect()}
    assert min(p[i] for i in range(1, 60, 2)) > max(p[i] for i in range(0, 60, 2))


def test_latex_becomes_text(spark):
    from inkwell.plans import reading
    from inkwell.sources.latex import latex_text, plain

    assert one(spark, latex_text, reading.LATEX[0][1]) == reading.LATEX_TEXT
    assert spark.createDataFrame([(None,), ("",)], "s string").select(latex_text(F.col("s")).alias("t")).collect() == [(None,), ("",)]
    assert plain(r"\section{A {nested \emph{b}} c} x") == "A {nested b} c\n\nx"
    assert plain(r"a \href{http://x}{t} b \url{u}\footnote{n \textbf{q}} \cite{k} $x_{1}$") == r"a t (http://x) b u (n q) \cite{k} $x_{1}$"
    assert plain(r"\begin{table}[h]\caption{C \emph{d}}{\begin{tabular}{ll}a & b\end{tabular}\end{table} after") == "C d\n\nafter"
    assert plain(r"open {\emph{x") == r"open {\emph{x" and plain(r"\href{a}{b") == r"\href{a}{b" and plain("50\\% % note\nnext } z") == "50% next } z" and plain("\\") == "\\"
    assert plain("a" + " " * 200_000 + r"{\emph{" * 2000 + "b").startswith("a {")


def test_folder_reads_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Hello\r\nthere".encode())
    (tmp_path / "b.tex").write_text("\\section{One} text")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {r.name: (r.kind, r.text) for r in L.folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("txt", "Hello\nthere"), "b.tex": ("tex", "One\n\ntext"), "c.pdf": ("pdf", None)}


def test_words_fold_compatibility_forms(spark):
    import unicodedata

    plain = [f"a{c}b" for c in T.WIDE] + [f"{f}x" for f, _ in T.LIGATURES]
    got = spark.createDataFrame([(w,) for w in plain], "w string").select(T.words(F.col("w")).alias("ws")).collect()
    assert [r.ws for r in got] == [[unicodedata.normalize("NFKC", w).lower()] for w in plain]
    odd = "Тhе pro\u200bcess ＡＢ１ oﬃce d’un Éa naïve it's"
    assert one(spark, T.words, odd) == ["the", "process", "ab1", "office", "d'un", "éa", "naïve", "it's"]


def test_windows_of_a_hot_source_are_those_of_least_ids(spark):
    from inkwell.operators import reviewing as V

    rng = random.Random(4)
    rows = [(1 << 50 if i == 7 else i, "hot" if i % 3 else None if i % 2 else "cold", " ".join(["w"] * rng.randrange(12)) if i % 11 else None) for i in range(900)]
    want = []
    for source in ("hot", "cold", None):
        all_ = [(source, i, k) for i, s, t in sorted(rows, key=lambda r: r[0]) if s == source for k in range(len((t or "").split()) // 3)]
        want += all_[:150]
    got = V.corpus_windows(spark.createDataFrame(rows, "doc_id long, source string, text string"), size=3).collect()
    assert sorted(((r.source, r.doc_id, r.ix) for r in got), key=repr) == sorted(want, key=repr)
    assert V.corpus_windows(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


@pytest.mark.parametrize("together", [1, 2, 3])
def test_near_pairs_of_equal_hashes(spark, together):
    d = spark.createDataFrame([(i, "00ff00ff00ff00ff" if i < 5 else f"{0xFF00FF00FF00FF ^ (1 << 63):016x}", []) for i in range(7)], "id long, hash string, variants array<struct<transform:string,hash:string>>")
    got = {(r.a, r.b, r.distance) for r in X.near_pairs(d, together=together).collect()}
    assert got == {(a, b, int(a < 5 <= b)) for a in range(7) for b in range(a + 1, 7)}


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = [b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 4, 8, 14)]
    d = spark.createDataFrame([(i, f"{h & (2**64 - 1):016x}", [("flipped", f"{~h & (2**64 - 1):016x}")]) for i, h in enumerate(hashes)], "id long, hash string, variants array<struct<transform:string,hash:string>>")
    want = set()
    for i, x in enumerate(hashes):
        for j in range(i + 1, len(hashes)):
            y = hashes[j]
            n = min(bin((x ^ y) & (2**64 - 1)).count("1"), bin((x ^ ~y) & (2**64 - 1)).count("1"))
            if n <= 8:
                want.add((i, j, n))
    assert {(r.a, r.b, r.distance) for r in X.near_pairs(d).collect()} == want


def test_covering_mean_reaches_every_word(spark, small):
    from inkwell import catalogue
    from inkwell.plans.common import texts

    got = {r.doc_id: r.n for r in catalogue.QUERIES["j08_all_words_mean"](spark, small).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r.doc_id: r.n for r in texts(spark, small).select("doc_id", F.size(T.raw_words(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    assert max(want.values()) > 201 and got == {i: n for i, n in want.items() if n}
