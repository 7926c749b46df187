"""Pairs of a whole corpus and order-dependent folds: against SQL and plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from inkwell.operators import authors, lines, overlap, pairing, pieces
from inkwell.plans import citing, reading
from inkwell.plans import pairing as pairing_plans
from inkwell.sources import extensions
from inkwell.streaming import limits
from oracle import difference

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(pairing_plans.ORACLES))
def test_pairs_agree_with_sql(spark, name):
    assert difference(pairing_plans.QUERIES[name](spark, SF), pairing_plans.ORACLES[name], SF) == ""


def test_pairs_and_passages_tell_all_shared_runs(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)]
    phrase = [" ".join(rng.choice(pool) for _ in range(9)) for _ in range(8)]
    texts = [" ".join([rng.choice(pool) for _ in range(rng.randrange(0, 12))] + [rng.choice(phrase[: 1 + i % 8])] + [rng.choice(pool)]) for i in range(120)] + ["", "one two"]
    texts += texts[:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(texts) if i < j and t != u and grams(t) & grams(u)}
    classes = pairing.stored(pairing.text_classes(docs))
    of = {r.doc_id: r.class_id for r in classes.collect()}
    assert of == {i: first[t] if t else i for i, t in enumerate(texts)}
    found = pairing.occurrences(docs, classes)
    for hot in (1, 5, 1000):
        linked = {(r.a, r.b) for r in pairing.class_pairs(found, classes, hot=hot).collect()}
        common = {}
        for r in pairing.common_passages(found, docs, hot=hot).collect():
            common.setdefault(r.passage, set()).add(r.class_id)
        together = linked | {(a, b) for s in common.values() for a in s for b in s if a < b}
        assert {(i, j) for i in of for j in of if i < j and of[i] != of[j] and tuple(sorted((of[i], of[j]))) in together} == want
        assert (hot == 1) == (not linked) and (hot == 1000) == (not common)


def log_rows(n=900, seed=1):
    """A log in which one service has most rows; ties, bursts and long failing stretches."""
    rng = random.Random(seed)
    t, out = 1_700_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 40, 400])
        out.append(("hot" if rng.random() < 0.8 else rng.choice(["b", "c"]), t, n - i, rng.random() < (0.05 if 300 < i < 500 else 0.6)))
    return out


def in_order(rows):
    by = {}
    for s, t, i, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(s, []).append((t, i, ok))
    return by


def log_table(spark, rows):
    d = spark.createDataFrame(rows, "service string, t long, id long, ok boolean")
    return d.select("service", F.timestamp_millis("t").alias("ts"), "id", "ok")


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_blocks_of_a_hot_service_give_what_one_pass_gives(spark, block):
    rows = log_rows()
    d, by = log_table(spark, rows), in_order(rows)
    paced, used, broken = {}, {}, {}
    for s, log in by.items():
        free, until, run = None, -1, 0
        for n, (t, i, ok) in enumerate(log):
            free = t if free is None else max(t, free + 50)
            paced[i] = (n, t, free if n < 500 else None)
            used[i] = "primary" if t >= until and ok else "fallback"
            until = t + 700 if t >= until and not ok else until
            run = 0 if ok else run + 1
            if run == 4:
                first, times = broken.get(s, (t, 0))
                broken[s] = (first, times + 1)
    assert {r.id: (r.n, r.ms, r.start_ms) for r in limits.paced(d, 50, 500, block).collect()} == paced
    assert {r.id: r.used for r in limits.with_fallback(d, 700, block).collect()} == used
    assert {r.service: (r.stopped_ms, r.times) for r in limits.breaker(d, 4, block).collect()} == broken


def test_blocks_of_no_rows(spark):
    d = log_table(spark, [])
    assert limits.paced(d, 5, 5).count() == limits.with_fallback(d, 5).count() == limits.breaker(d).count() == 0


def plain_bridges(runs, gap=2):
    merged = []
    for r in sorted(runs, key=lambda r: (r[0], -r[1], r[2])):
        if merged:
            last = merged[-1]
            if 0 <= r[0] - last[1] <= gap and 0 <= r[2] - (last[2] + last[1] - last[0]) <= gap:
                merged[-1] = (last[0], r[1], last[2], last[3] + r[3])
                continue
            if r[0] < last[1] and r[1] <= last[1]:
                continue
        merged.append(r)
    return merged


def plain_drops(runs):
    taken, kept = set(), []
    for r in sorted(runs, key=lambda r: (-r[3], r[0], r[1], r[2])):
        span = set(range(r[0], r[1]))
        if 2 * len(span & taken) <= len(span):
            taken |= span
            kept.append(r)
    return kept


def test_runs_are_bridged_and_dropped_as_by_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for pair in range(60):
        for _ in range(rng.randrange(1, 25)):
            s, n = rng.randrange(0, 80), rng.randrange(3, 20)
            rows.append((pair, pair % 7, s, s + n, rng.choice([s, s + 1, s + 2, rng.randrange(0, 80)]), n))
    d = spark.createDataFrame(rows, "doc_id long, source_id long, start long, end long, source_start long, words long")
    for made, plain in ((overlap.bridged, plain_bridges), (overlap.without_overlaps, plain_drops)):
        got = {}
        for r in made(d).collect():
            got.setdefault(r.doc_id, []).append(tuple(r)[2:])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain([r[2:] for r in rows if r[0] == k])) for k in range(60)}
    assert overlap.bridged(d.limit(0)).count() == 0


# pieces of texts

ODD = [
    "See $a$ and $$b\n c$$ in (Smith et al., 2020) or Jones (2019, p. 4); https://x.org/a)b 10.1000/ab,c [1, 2-3] \\cite[x]{k} Figure 3a – 4.",
    "$x (Smith, 2020) y$ then \\(a $b$ c\\) and Table 2 [7] [8;9], $$$$ $ $ $",
    "", "plain words", "\\[ \\( x \\] \\) $1 [2] 3$ https://a.b/10.1000/x. Fig. 2 Figures 3-5",
]


def spans_by_loop(text):
    import regex

    found = []
    for i, (kind, p) in enumerate(pieces.STREAMS):
        found += [(m.start(), m.start() - m.end(), i, kind) for m in regex.finditer(p, text)]
    out, end = [], 0
    for s, less, _, kind in sorted(found):
        if s >= end:
            end = s - less
            out.append((len(out) + 1, kind, s, end, text[s:end]))
    return out


def documents(spark, sf, extra=()):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return d.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(extra)], "doc_id long, text string")) if extra else d


def test_protected_stretches_are_those_of_a_plain_scan(spark):
    d = documents(spark, SF, ODD)
    got = {}
    for r in pieces.protected_spans(d).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {r.doc_id: s for r in d.collect() if (s := spans_by_loop(r.text or ""))}
    assert got == want and any(k < 0 for k in got)
    kept = spark.createDataFrame([(1, "Keep this: Keep Thistle, keep this. [1]")], "doc_id long, text string")
    assert [(r.kind, r.start) for r in pieces.protected_spans(kept, ("keep this",)).collect()] == [("keep", 0), ("keep", 25), ("cite", 36)]
    t = F.coalesce("text", F.lit(""))
    masks = d.where("doc_id < 0").select("doc_id", pieces.masked(t, pieces.protected(t)).alias("m")).collect()
    for r in masks:
        text, at, out = ODD[-r.doc_id - 1], 0, ""
        for i, _, s, e, _ in spans_by_loop(text):
            out, at = out + text[at:s] + f"{{{{P{i}}}}}", e
        assert r.m == out + text[at:]


def brackets_by_loop(text):
    import re

    out = []
    at = 0
    for part, gap in zip(re.split(r"\n\s*\n", text), [*re.findall(r"\n\s*\n", text), ""], strict=True):
        body = re.sub(r"(?m)^[ \t]*(?:\d+|[a-zA-Z])\)", lambda m: " " * len(m[0]), part)
        stack = []
        for i, c in enumerate(body):
            if c in "([{“":
                stack.append((c, i))
            elif c in pieces.CLOSERS:
                if stack and stack[-1][0] == pieces.CLOSERS[c]:
                    stack.pop()
                else:
                    out.append(("unbalanced-brackets", at + i, c))
        out += [("unbalanced-brackets", at + i, c) for c, i in stack]
        q = [i for i, c in enumerate(body) if c == '"']
        if len(q) % 2:
            out.append(("unbalanced-quotes", at + q[-1], '"'))
        at += len(part) + len(gap)
    return sorted(out)


def test_brackets_pair_as_on_a_stack(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(list("()[]{}“”\"ab \n\n1)")) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    d = documents(spark, SF, ["1) fine\n a) too\n x (open\n\nclose) here ]", *made])
    got = {}
    for r in pieces.bracket_issues(d).collect():
        assert r.end == r.start + 1
        got.setdefault(r.doc_id, []).append((r.rule, r.start, r.mark))
    assert {k: sorted(v) for k, v in got.items()} == {r.doc_id: b for r in d.collect() if (b := brackets_by_loop(r.text or ""))}


PAPER = (
    "1. INTRODUCTION\nThe first paragraph has more than eight words and it stands under its heading here.\nE = mc² + x (3)\nIt goes on after the formula with some more words, e.g. these ones. And it ends.\n\n"
    "  Results and Discussion\nB. Some Heading\n" + "A sentence of the long paragraph stands here, Fig. 2 shows it. " * 60 + "\n\n\n  * short\n\nReferences\n\n[1] Smith, J. A book with a title. Some press, 2001, and other words that follow it."
)


def test_plans_rebuild_every_text(spark):
    d = documents(spark, SF, [PAPER, "", " \n\n ", "\n\nx\n\n"])
    plan = pairing.stored(pieces.planned(d))
    none = spark.createDataFrame([], "doc_id long, ix int, new string")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert {r.doc_id: r.text for r in pieces.rebuilt(d, plan, none).collect()} == texts
    rows = {}
    for r in plan.orderBy("doc_id", "ix").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for k, ps in rows.items():
        assert [p.ix for p in ps] == list(range(len(ps))) and all(texts[k][p.start : p.end].strip() == texts[k][p.start : p.end] != "" for p in ps)
        assert all(a.end <= b.start and not texts[k][a.end : b.start].strip() for a, b in zip(ps, ps[1:], strict=False)) and not texts[k][: ps[0].start].strip() and not texts[k][ps[-1].end :].strip()
        assert all(p.end - p.start <= 2500 or texts[k][p.start : p.end].count(". ") < 2 for p in ps if p.rewrite)
    own = [(p.kind, texts[-1][p.start : p.end][:20], p.rewrite) for p in rows[-1]]
    assert own[:4] == [("heading", "1. INTRODUCTION", False), ("paragraph", "The first paragraph ", True), ("formula", "E = mc² + x (3)", False), ("paragraph", "It goes on after the", True)]
    assert [k for k, *_ in own[4:6]] == ["heading", "heading"] and sum(t.startswith("A sentence") and w for _, t, w in own) == 2 and not own[-1][2]
    new = plan.where("rewrite").select("doc_id", "ix", F.lit("New  text.").alias("new"))
    assert next(r.text for r in pieces.rebuilt(d, plan, new).collect() if r.doc_id == -1).startswith("1. INTRODUCTION\nNew  text.\nE = mc² + x (3)\nNew  text.\n\n  Results")
    edits = [(r.start, r.text) for r in pieces.paragraph_edits(d, plan, new).where("doc_id = -1").orderBy("start").collect()]
    assert [t for _, t in edits] == ["New text.", "New text.", "New text. New text."] and pieces.paragraph_edits(d, plan, none).count() == 0
    cut = pieces.planned_chunks(d, 300).collect()
    assert {r.doc_id: r.text for r in pieces.rebuilt(d, spark.createDataFrame(cut), none).collect()} == texts


def test_words_in_pieces_of_a_vocabulary(spark, small):
    rng = random.Random(6)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(25)} | {"##" + "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(25)} | {".", "a"})

    def split(w):
        out, at = [], 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocab), None)
            if end is None or len(w) > 100:
                return ["[UNK]"]
            out.append(("##" if at else "") + w[at:end])
            at = end
        return out

    texts = [" ".join("".join(rng.choice("abcab") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "!"]) for _ in range(12)) for _ in range(60)] + ["a" * 101, "", None, "ÀB"]
    got = pieces.wordpieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(v,) for v in vocab], "piece string")).collect()
    assert len(got) > 700 and all(r.pieces == split(r.token) for r in got) and any(len(r.pieces) > 1 for r in got)


# authors and lines

BLOCKS = [
    "Smith, J., & Lee, K.", "J. A. Smith, K. Lee, and P. van Dyke", "Garcia M, Chen LP, Diaz Q", "Smith, John, Kate Lee, and Ann de la Cruz.", "World Health Organization", "Brown, A., et al.",
    "Müller-Lüdenscheidt, H.-J.; O’Neil, S.", "Plato", "Lee, K. ... Park, S.-J.", "lower case only", "", "The University Press and Ann Lee", "Kim, J.; 12 monkeys", "A. B. Cee & D. Eff", "van der Berg, T., Ng, X",
]


def authors_by_loop(raw):
    import regex

    block = regex.sub(r"[,;:\s]+$", "", raw.strip())
    block = regex.sub(r"([\p{Ll}0-9)])\.$", r"\1", block)
    truncated = bool(regex.search(r"(?i)\bet\s+al\.?$", block))
    block = regex.sub(r"\s*\.\.\.\s*", ", ", regex.sub(r"(?i),?\s*\bet\s+al\.?$", "", block)).strip()
    if not block:
        return [], truncated
    if regex.search(authors.ORGANISATION, block) and not regex.search(r",\s*\p{Lu}\.|(?:^|\s)\p{Lu}\.\s*\p{Lu}", block) and not regex.search(r"\sand\s\p{Lu}\p{Ll}+\s\p{Lu}\p{Ll}+$", block):
        return [(block, None, True)], truncated
    best = (0, [])
    for layout in authors.LAYOUTS:
        names, at, consumed = [], 0, 0
        while True:
            hit = next(((m, f, g, bare) for p, f, g, bare in layout if (m := regex.compile(p).match(block, at))), None)
            if hit is None:
                break
            m, f, g, bare = hit
            given = " ".join(c + "." for c in m[g]) if bare else regex.sub(r"\s*-\s*", "-", regex.sub(r"\s+", " ", m[g]).strip())
            names.append((m[f].strip(), given, False))
            at = consumed = m.end()
            gap = regex.compile(authors.SEPARATOR).match(block, at)
            if not gap:
                break
            at = gap.end()
        if names and (consumed > best[0] or (consumed == best[0] and len(names) > len(best[1]))):
            best = (consumed, names)
    if best[1] and best[0] >= 0.85 * len(block):
        return best[1], truncated
    if regex.match(r"^\p{Lu}[\p{L}&'’\-. ]{2,}$", block) and "," not in block:
        return [(block, None, True)], truncated
    return best[1], truncated


def test_author_blocks_are_read_as_by_plain_scans(spark, small):
    d = spark.createDataFrame([(b,) for b in BLOCKS], "b string").unionByName(citing.lead_blocks(spark, small).select(F.col("lead").alias("b")))
    rows = d.select("b", authors.parsed(F.col("b")).alias("p")).collect()
    assert len(rows) > 300
    for r in rows:
        assert ([tuple(a) for a in r.p.authors], r.p.truncated) == authors_by_loop(r.b), r.b
    assert [a.family for a in rows[1].p.authors] == ["Smith", "Lee", "van Dyke"] and rows[5].p.truncated and rows[4].p.authors[0].organization


def lines_by_loop(raw):
    import re

    page = re.compile(r"(?i)^(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?$")
    ls = [x.strip(" ") for x in re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", raw).replace("­", "")).split("\n")]
    content = [x for x in ls if x and not page.match(x)]
    mean = sum(map(len, content)) / len(content) if content else 0
    out = ""
    for i, x in enumerate(ls):
        if not x:
            out += "\n\n" if out and not out.endswith("\n\n") else ""
        elif page.match(x):
            continue
        elif not out or out.endswith("\n\n"):
            out += x
        else:
            before = next(y for y in reversed(ls[:i]) if y)
            if re.search(r"[a-z]-$", out) and re.match("[a-z]", x):
                out = out[:-1] + x
            elif (re.search(r'[.!?:]["”)]?$', before) and len(before) < mean * 0.7 and re.match(r'[A-Z0-9\[“"(]', x)) or re.match(lines.HEADING, x) or re.match(lines.HEADING, before):
                out += "\n\n" + x
            else:
                out += " " + x
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def test_broken_lines_are_joined_as_by_a_plain_loop(spark, small):
    rng = random.Random(9)
    made = []
    for _ in range(200):
        made.append("\n".join(rng.choice(["", " ", "12", "Page 3 of 9", "Results", "2.1 Methods", "a broken wo-", "rd goes on here and on", "The end.", "A short one.", "Another line of some length stands here", "with\tmore  blanks", "x-"]) for _ in range(rng.randrange(0, 14))))
    d = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(reading.broken(spark, small))
    rows = d.select("text", lines.rejoined(F.col("text")).alias("t")).collect()
    assert all(r.t == lines_by_loop(r.text) for r in rows) and len(rows) > 350


def test_library_reader_leaves_files_unread(spark, tmp_path):
    for name, text in {"a.txt": "one", "b.md": "two\n", "sub/c.TEX": "three", "README.md": "no", ".x.txt": "no", "d.pdf": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    extensions.register(spark)
    r = spark.read.format("inkwell_library")
    all_ = r.load(str(tmp_path))
    assert {(x.name, x.kind, x.text) for x in all_.collect()} == {("a.txt", "txt", "one"), ("b.md", "md", "two\n"), ("c.TEX", "tex", "three")}
    assert [x.name for x in all_.where("kind in ('tex', 'pdf') and length(text) > 2").collect()] == ["c.TEX"] and all_.where("name = 'b.md'").count() == 1
    assert r.option("taskBytes", 4).load(f"file://{tmp_path}").rdd.getNumPartitions() == 3
    reader = extensions.LibraryReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([EqualTo(("kind",), "md")])) == [] and [len(p.paths) for p in reader.partitions()] == [1]
