"""Overlap of documents with sources: seed n-grams, exact runs, coverage, credit, comparison.

The sources' side of the seed join is what is usually small; Spark broadcasts it only where its measured size allows, and
else shuffles both sides on the gram. Hits are few, so all that follows (gaps-and-islands, span checks, credit) works on
small tables; the words of a run are looked up in its document's word array by a join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.tokens import grams_of, hashed_ngrams, ngrams, with_words, word_hashes
from inkwell.tables import stored

SEED = 3
MIN_RUN = 6
MIN_CONTENT = 0.4
MIN_DISTINCT = 4


def seed_hits(docs: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source_id, pos, source_pos of every shared n-gram. sources: source_id, text."""
    s = ngrams(sources.select(F.col("source_id").alias("doc_id"), "text"), seed)
    s = s.select(F.col("doc_id").alias("source_id"), F.col("pos").alias("source_pos"), "gram")
    return ngrams(docs, seed).join(s, "gram").select("doc_id", "source_id", "pos", "source_pos")


def exact_runs(hits: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source_id, start, end, source_start, words: maximal runs of equal words, one for each stretch of a diagonal."""
    k = F.col("pos") - F.col("source_pos")
    h = hits.withColumn("k", k)
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "source_id", "k").orderBy("pos"))
    runs = h.withColumn("island", island).groupBy("doc_id", "source_id", "k", "island").agg(F.min("pos").alias("start"), F.min("source_pos").alias("source_start"), (F.count("*") + seed - 1).alias("words"))
    return runs.select("doc_id", "source_id", "start", (F.col("start") + F.col("words")).alias("end"), "source_start", "words")


def accepted(runs: DataFrame, docs: DataFrame, min_run: int = MIN_RUN, min_content: float = MIN_CONTENT, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """Runs that are long enough, not mostly stop words and of several distinct words."""
    inside = F.slice("words_", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    r = runs.where(F.col("words") >= max(SEED, min_run)).join(with_words(docs).withColumnRenamed("words", "words_"), "doc_id").withColumn("inside", inside)
    content = F.size(F.filter("inside", lambda w: ~T.is_stopword(w))) / F.size("inside")
    return r.where((content >= min_content) & (F.size(F.array_distinct("inside")) >= min_distinct)).select(runs.columns)


def covered_positions(runs: DataFrame) -> DataFrame:
    """doc_id, source_id, pos: each position once for each source that covers it."""
    return runs.select("doc_id", "source_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct()


def verdict(similarity: Column) -> Column:
    return F.when(similarity < 10, "low").when(similarity < 25, "moderate").otherwise("high")


def similarity(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, words, matched, similarity (%), verdict, source_id (the source with most words) for every document."""
    pos = covered_positions(runs)
    matched = pos.groupBy("doc_id").agg(F.countDistinct("pos").alias("matched"))
    best = pos.groupBy("doc_id", "source_id").count().groupBy("doc_id").agg(F.max_by("source_id", F.struct("count", -F.col("source_id"))).alias("source_id"))
    d = docs.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words")).join(matched, "doc_id", "left").join(best, "doc_id", "left")
    d = d.withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    d = d.withColumn("similarity", F.floor(F.col("matched") * 1000 / F.greatest("words", F.lit(1)) + 0.5) / 10)
    return d.select("doc_id", "words", "matched", "similarity", verdict(F.col("similarity")).alias("verdict"), "source_id")


def credited_spans(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, start, end, source_id, n_sources: maximal covered stretches and who is credited (most words, oldest, first).

    sources: source_id, year (may be null)."""
    pos = covered_positions(runs).select("doc_id", "pos").distinct()
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    spans = pos.withColumn("i", island).groupBy("doc_id", "i").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("i")
    who = spans.join(covered_positions(runs), "doc_id").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    who = who.groupBy("doc_id", "start", "end", "source_id").count().join(sources.select("source_id", F.coalesce("year", F.lit(9999)).alias("year")), "source_id")
    return who.groupBy("doc_id", "start", "end").agg(F.min_by("source_id", F.struct(-F.col("count"), "year", "source_id")).alias("source_id"), F.count("*").alias("n_sources"))


def bridged(runs: DataFrame, max_gap: int = 2) -> DataFrame:
    """runs with neighbours joined that go on in both texts after at most max_gap words; runs inside the one before fall out.

    A fold over a pair's runs in order of their start (longest first): the run before is what has been joined so far."""
    r = runs.groupBy("doc_id", "source_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("less"), "source_start", "words"))).alias("rs"))
    one = lambda x: F.struct(x["start"].alias("start"), (-x["less"]).alias("end"), x["source_start"].alias("source_start"), x["words"].alias("words"))
    kind = "struct<start:bigint,end:bigint,source_start:bigint,words:bigint>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))

    def put(acc: Column, x: Column) -> Column:
        last, run = acc["last"], one(x).cast(kind)
        gap, source_gap = run["start"] - last["end"], run["source_start"] - (last["source_start"] + last["end"] - last["start"])
        joined = F.struct(last["start"].alias("start"), run["end"].alias("end"), last["source_start"].alias("source_start"), (last["words"] + run["words"]).alias("words")).cast(kind)
        goes_on = gap.between(0, max_gap) & source_gap.between(0, max_gap)
        inside = (run["start"] < last["end"]) & (run["end"] <= last["end"])
        more = lambda done, now: F.struct(done.alias("done"), now.alias("last"))
        return F.when(last.isNull(), more(acc["done"], run)).when(goes_on, more(acc["done"], joined)).when(inside, acc).otherwise(more(F.array_append(acc["done"], last), run))

    out = F.aggregate("rs", begin, put, lambda acc: F.array_append(acc["done"], acc["last"]))
    return r.select("doc_id", "source_id", F.inline(out))


def without_overlaps(runs: DataFrame) -> DataFrame:
    """runs of a pair, most words first (then by place); one of which more than half is covered by those before falls out.

    Covered words are kept as a list of stretches apart from each other: a run and all stretches it meets make one."""
    kind = "struct<start:bigint,end:bigint,source_start:bigint,words:bigint>"
    r = runs.groupBy("doc_id", "source_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("less"), "start", "end", "source_start"))).alias("rs"))
    begin = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("cover"), F.array().cast(f"array<{kind}>").alias("kept"))

    def put(acc: Column, x: Column) -> Column:
        meets = lambda c: (c["s"] < x["end"]) & (c["e"] > x["start"])
        met = F.filter(acc["cover"], meets)
        already = F.aggregate(met, F.lit(0).cast("long"), lambda n, c: n + F.least(c["e"], x["end"]) - F.greatest(c["s"], x["start"]))
        whole = F.struct(F.least(x["start"], F.array_min(F.transform(met, lambda c: c["s"]))).alias("s"), F.greatest(x["end"], F.array_max(F.transform(met, lambda c: c["e"]))).alias("e"))
        run = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["source_start"].alias("source_start"), (-x["less"]).alias("words")).cast(kind)
        taken = F.struct(F.array_append(F.filter(acc["cover"], lambda c: ~meets(c)), whole).alias("cover"), F.array_append(acc["kept"], run).alias("kept"))
        return F.when(already * 2 > x["end"] - x["start"], acc).otherwise(taken)

    return r.select("doc_id", "source_id", F.inline(F.aggregate("rs", begin, put, lambda acc: acc["kept"])))


def bridged_runs(hits: DataFrame, docs: DataFrame, min_run: int = MIN_RUN, max_gap: int = 2, seed: int = SEED) -> DataFrame:
    """doc_id, source_id, start, end, source_start, words: runs with small edits bridged, weaker runs inside stronger ones dropped."""
    return without_overlaps(accepted(bridged(exact_runs(hits, seed), max_gap), docs, min_run))


def compare_papers(papers: DataFrame, min_run: int = 8) -> DataFrame:
    """a, b, a_percent, b_percent, shared_words for pairs of papers (doc_id, text) that share a run of min_run words.

    For sets of papers that are compared with each other, such as one class's submissions; see corpus_shared for a corpus."""
    hits = seed_hits(papers, papers.select(F.col("doc_id").alias("source_id"), "text")).where("doc_id < source_id")
    runs = accepted(exact_runs(hits), papers, min_run)
    a = covered_positions(runs).groupBy("doc_id", "source_id").agg(F.count("*").alias("a_words"))
    b = runs.select("doc_id", "source_id", F.explode(F.sequence(F.col("source_start"), F.col("source_start") + F.col("words") - 1)).alias("p")).distinct().groupBy("doc_id", "source_id").agg(F.count("*").alias("b_words"))
    n = papers.select("doc_id", F.greatest(T.word_count(F.col("text")), F.lit(1)).alias("n"))
    pairs = a.join(b, ["doc_id", "source_id"]).join(n, "doc_id").withColumnRenamed("n", "na").join(n.select(F.col("doc_id").alias("source_id"), F.col("n").alias("nb")), "source_id")
    one = lambda w, t: F.floor(F.col(w) * 1000 / F.col(t) + 0.5) / 10
    return pairs.select(F.col("doc_id").alias("a"), F.col("source_id").alias("b"), one("a_words", "na").alias("a_percent"), one("b_words", "nb").alias("b_percent"), F.col("a_words").alias("shared_words"))


def corpus_shared(docs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, words, shared_words, shared_percent: the part of each document in n-grams that another document has too.

    Linear in the corpus whatever the groups: grams are counted by document, never paired. Grams are made twice (counted, then met), so
    the texts' word hashes are stored."""
    g = grams_of(stored(word_hashes(docs), "word-hashes"), n)
    common = g.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("g")
    hit = g.join(common, "g").groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    # covered words: each hit adds n, less what the hit before already covers
    covered = F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(0), lambda s, i: s + F.when(i == 1, F.lit(n)).otherwise(F.least(F.lit(n), F.element_at("at", i) - F.element_at("at", F.greatest(i - 1, F.lit(1))))))
    d = docs.select("doc_id", T.word_count(F.col("text")).cast("long").alias("words")).join(hit.select("doc_id", covered.cast("long").alias("shared_words")), "doc_id", "left")
    d = d.withColumn("shared_words", F.coalesce("shared_words", F.lit(0)))
    return d.select("doc_id", "words", "shared_words", (F.floor(F.col("shared_words") * 1000 / F.greatest("words", F.lit(1)) + 0.5) / 10).alias("shared_percent"))


def self_repeats(docs: DataFrame, min_run: int = 12) -> DataFrame:
    """doc_id, start, again, words: maximal stretches that a document repeats later without overlap (first partner only)."""
    g = hashed_ngrams(docs, min_run)
    nxt = F.lead("pos").over(W.partitionBy("doc_id", "g").orderBy("pos"))
    p = g.withColumn("again", nxt).where(F.col("again") - F.col("pos") >= min_run)
    k = F.col("again") - F.col("pos")
    p = p.withColumn("k", k).withColumn("i", F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "k").orderBy("pos")))
    r = p.groupBy("doc_id", "k", "i").agg(F.min("pos").alias("start"), F.min("again").alias("again"), (F.count("*") + min_run - 1).alias("words"))
    return r.select("doc_id", "start", "again", F.least(F.col("words"), F.col("k")).alias("words"))


def sentence_words(docs: DataFrame) -> DataFrame:
    """doc_id, ix, start, words: the word positions that each sentence covers (sentences cut at blanks, words never do)."""
    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))
    s = s.select("doc_id", "ix", T.word_count(F.col("sentence")).cast("long").alias("words"))
    before = F.sum("words").over(W.partitionBy("doc_id").orderBy("ix").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    return s.select("doc_id", "ix", before.alias("start"), "words")


def significant(runs: DataFrame, docs: DataFrame, total: int = 15, alone: int = 10, short: int = 8) -> DataFrame:
    """Leaves out stock phrases: where a document and source share under `total` words, a run needs `alone` words, or `short`
    words and half of its sentence."""
    all_ = F.sum("words").over(W.partitionBy("doc_id", "source_id"))
    s = sentence_words(docs).select("doc_id", F.col("start").alias("s_start"), F.col("words").alias("s_words"))
    few = runs.withColumn("all", all_)
    inside = few.where(F.col("all") < total).join(s, "doc_id").where((F.col("start") >= F.col("s_start")) & (F.col("start") < F.col("s_start") + F.col("s_words")))
    kept = inside.where((F.col("words") >= alone) | ((F.col("words") >= short) & (F.col("words") * 2 >= F.col("s_words"))))
    return few.where(F.col("all") >= total).select(runs.columns).unionByName(kept.select(runs.columns))


def concept_rows(sentences: DataFrame) -> DataFrame:
    """doc_id, ix, concept (distinct) of sentences(doc_id, ix, text): stems of content words, synonyms folded.

    The synonym table is fixed (about a thousand forms), so it is broadcast."""
    heads = sentences.sparkSession.createDataFrame(sorted(T.concept_heads().items()), "stem string, head string")
    w = sentences.select("doc_id", "ix", F.explode(T.words(F.col("text"))).alias("word"))
    w = w.where((F.length("word") >= 3) & ~T.is_stopword(F.col("word")) & ~F.col("word").rlike("^[0-9]+$"))
    w = w.select("doc_id", "ix", T.stem(F.col("word")).alias("stem")).join(F.broadcast(heads), "stem", "left")
    return w.select("doc_id", "ix", F.coalesce("head", "stem").alias("concept")).distinct()


def paraphrases(sentences: DataFrame, source_sentences: DataFrame, threshold: float = 0.65, least: int = 7, shared: int = 5) -> DataFrame:
    """doc_id, ix, source_id, source_ix, similarity: the source sentence that shares most concepts with each sentence.

    An inverted index in two shuffles: concepts meet, meetings are counted. Concepts that only documents have fall out in
    the join with the sources' (smaller) side."""
    size = lambda c: F.count("*").over(W.partitionBy(c, "ix"))
    a = concept_rows(sentences).withColumn("n", size("doc_id")).where(F.col("n") >= least)
    b = concept_rows(source_sentences.withColumnRenamed("source_id", "doc_id")).withColumn("m", size("doc_id")).where(F.col("m") >= least - 2)
    b = b.select(F.col("doc_id").alias("source_id"), F.col("ix").alias("source_ix"), "concept", "m")
    p = a.join(b, "concept").groupBy("doc_id", "ix", "source_id", "source_ix", "n", "m").agg(F.count("*").alias("c")).where(F.col("c") >= shared)
    p = p.withColumn("similarity", (F.col("c") / F.col("n") + F.col("c") / F.col("m")) / 2).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("source_id", "source_ix", "similarity"), F.struct(F.round("similarity", 9), -F.col("source_id"), -F.col("source_ix"))).alias("b")
    return p.groupBy("doc_id", "ix").agg(best).select("doc_id", "ix", "b.source_id", "b.source_ix", F.round("b.similarity", 2).alias("similarity"))


def word_weight(word: Column) -> Column:
    """35 times a word's weight, whole: stop words 0, numbers 0.2, others 1 to 3 by length."""
    return F.when(T.is_stopword(word), 0).when(word.rlike("^[0-9]+$"), 7).otherwise(35 + 5 * F.least(F.length(word), F.lit(14)))


def best_phrases(docs: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, start, phrase, score: the weightiest run of `size` words (the first on ties; the whole text if shorter)."""
    w = with_words(docs).withColumn("weights", F.transform("words", lambda x: word_weight(x).cast("long")))
    n = F.least(F.size("words"), F.lit(size))
    # running sums by one fold over the weights: (window sum, best sum, best end)
    first = F.aggregate(F.slice("weights", 1, n), F.lit(0).cast("long"), lambda s, x: s + x)
    steps = F.arrays_zip(F.slice("weights", n + 1, F.size("words")).alias("new"), F.slice("weights", 1, F.greatest(F.size("words") - n, F.lit(0))).alias("old"))
    start = F.struct(first.alias("sum"), first.alias("best"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("i"))
    fold = F.aggregate(steps, start, lambda s, x: F.struct(
        (s["sum"] + x["new"] - x["old"]).alias("sum"), F.greatest(s["best"], s["sum"] + x["new"] - x["old"]).alias("best"),
        F.when(s["sum"] + x["new"] - x["old"] > s["best"], s["i"] + 1).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")))
    out = w.where(F.size("words") > 0).withColumn("b", fold)
    return out.select("doc_id", F.col("b.at").alias("start"), F.array_join(F.slice("words", F.col("b.at").cast("int") + 1, n), " ").alias("phrase"), (F.col("b.best") / 35).alias("score"))


def passages(docs: DataFrame, most: int = 40, least: int = 12) -> DataFrame:
    """doc_id, ix, score: sentences to search for. With over `most` candidates the text is cut in as many equal stretches
    and the most distinctive sentence (score 5 or more) of each is taken. Sentences under `least` words are not joined with
    the next one, which the sequential form does."""
    s = docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "sentence"))
    s = s.withColumn("raws", T.raw_words(F.col("sentence"))).where((F.size("raws") >= least) & ~F.col("sentence").rlike(r"(?i)^(?:table|figure|fig\.|equation)(?:[^A-Za-z0-9_]|$)"))
    content = lambda r: ~T.is_stopword(T.normal(r)) & ~r.rlike("^[0-9]+$")
    kept = F.filter("raws", content)
    proper = F.filter(F.slice("raws", 2, F.size("raws")), lambda r: content(r) & r.rlike("^[A-Z]") & ~r.rlike("^[A-Z]+$"))
    score = F.size(F.array_distinct(F.transform(kept, T.normal))) + 0.5 * F.size(F.filter(kept, lambda r: F.length(T.normal(r)) >= 9)) + 2 * F.size(proper)
    s = s.select("doc_id", "ix", score.alias("score"))
    doc = W.partitionBy("doc_id")
    s = s.withColumn("n", F.count("*").over(doc)).withColumn("last", F.max("ix").over(doc))
    s = s.where((F.col("n") <= most) | (F.col("score") >= 5))
    bin_ = F.when(F.col("n") <= most, F.col("ix")).otherwise(F.floor(F.col("ix") * most / (F.col("last") + 1)))
    rank = F.row_number().over(W.partitionBy("doc_id", "bin").orderBy(F.desc("score"), "ix"))
    return s.withColumn("bin", bin_).withColumn("rank", rank).where("rank = 1").select("doc_id", "ix", "score")


ISSUES = ("copied_uncited", "disguised", "tortured", "copied_cited", "own_work", "translated", "reworded_uncited", "quote_uncited", "reworded_cited", "repeated")


def quotations(docs: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, ix, quotation: quoted stretches of `least` characters or more on one line, white space collapsed."""
    found = F.filter(T.matches(F.coalesce("text", F.lit("")), r'["“][^"“”\n]{1,2000}?["”]'), lambda q: F.length(q) >= least)
    return docs.select("doc_id", F.posexplode(F.transform(found, lambda q: F.regexp_replace(q, r"\s+", " "))).alias("ix", "quotation"))


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """doc_id and a column for each kind: words in issues of that kind (quotations count one each)."""
    n = F.when(F.col("kind") == "quote_uncited", 1).otherwise(F.col("words"))
    return issues.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).cast("long").alias(k) for k in ISSUES])


def review(spans: DataFrame, docs: DataFrame, min_words: int = 0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, words, matched, similarity, verdict after a reader's filters.

    spans: doc_id, source_ids (best first), words; docs: doc_id, words. Sources in `excluded` fall out of their spans."""
    left = F.filter("source_ids", lambda s: ~s.isin(*excluded)) if excluded else F.col("source_ids")
    kept = spans.withColumn("source_ids", left).where((F.size("source_ids") > 0) & (F.col("words") >= min_words))
    m = kept.groupBy("doc_id").agg(F.sum("words").alias("matched"))
    d = docs.join(m, "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    d = d.withColumn("similarity", F.floor(F.col("matched") * 1000 / F.greatest("words", F.lit(1)) + 0.5) / 10)
    return d.select("doc_id", "words", "matched", "similarity", verdict(F.col("similarity")).alias("verdict"))
