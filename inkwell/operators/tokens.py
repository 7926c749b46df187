"""Token, n-gram, paragraph and sentence tables. Offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, words array<string>."""
    return docs.select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("words"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word: exploded in the scan's own tasks, no shuffle."""
    return docs.select("doc_id", F.posexplode(T.words(F.coalesce("text", F.lit("")))).alias("pos", "word"))


def token_spans(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, raw, word. Offsets come from running lengths of the pieces between words."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select("doc_id", T.raw_words(text).alias("raws"), F.split(text, T.WORD, -1).alias("gaps"))
    t = raw.select("doc_id", F.posexplode(F.arrays_zip("raws", F.slice("gaps", 1, F.greatest(F.size("raws"), F.lit(0))).alias("gap"))).alias("pos", "x"))
    t = t.select("doc_id", "pos", F.col("x.raws").alias("raw"), F.length("x.gap").alias("g"))
    run = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("end", F.sum(F.col("g") + F.length("raw")).over(run))
    return t.select("doc_id", "pos", (F.col("end") - F.length("raw")).alias("start"), "end", "raw", T.normal(F.col("raw")).alias("word"))


def chosen_spans(docs: DataFrame, pick) -> DataFrame:
    """doc_id, start, end, raw, gap (the text before it), last (the token before it) of the tokens that pick(raws), an array of
    booleans, chooses: a fold over the texts that have any, without a row for other tokens."""
    kind = "array<struct<start:int,end:int,raw:string,gap:string,last:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("last"), F.array().cast(kind).alias("out"))

    def put(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["raw"])
        one = F.struct(start.alias("start"), end.alias("end"), x["raw"].alias("raw"), x["gap"].alias("gap"), a["last"].alias("last"))
        return F.struct(end.alias("at"), x["raw"].alias("last"), F.when(x["pick"], F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

    def spans(text: Column, raws: Column, picked: Column) -> Column:
        parts = F.zip_with(raws, F.slice(F.split(text, T.WORD, -1), F.lit(1), F.size(raws)), lambda r, g: F.struct(r.alias("raw"), g.alias("gap")))
        items = F.zip_with(parts, picked, lambda x, p: F.struct(x["raw"].alias("raw"), x["gap"].alias("gap"), p.alias("pick")))
        return F.when(F.exists(picked, lambda p: p), F.aggregate(items, begin, put)["out"]).otherwise(F.array().cast(kind))

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.inline(T.let(T.raw_words(text), lambda raws: T.let(pick(raws), lambda picked: spans(text, raws, picked)))))


def ngrams(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, pos, gram: n words in a row, by shifted slices of the word array (no shuffle).

    Short texts give empty slices: a filter on the array's size would go below the projection and cut every text twice."""
    w = with_words(docs)
    shifted = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(F.size("words") - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)])
    return w.select("doc_id", F.posexplode(shifted).alias("pos", "g")).select("doc_id", "pos", F.concat_ws(" ", *[F.col(f"g.w{k}") for k in range(n)]).alias("gram"))


def word_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, h array<long>: a 64-bit hash of each word."""
    return docs.select("doc_id", F.transform(T.words(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)).alias("h"))


def hashed_ngrams(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, pos, g: a 64-bit hash of n words in a row. Words are hashed once, so rows carry numbers and no strings."""
    return grams_of(word_hashes(docs), n)


def grams_of(w: DataFrame, n: int) -> DataFrame:
    """hashed_ngrams of word_hashes, for users that need grams more than once and store the hashes."""
    shifted = F.arrays_zip(*[F.slice("h", k + 1, F.greatest(F.size("h") - n + 1, F.lit(0))).alias(f"h{k}") for k in range(n)])
    return w.select("doc_id", F.posexplode(shifted).alias("pos", "x")).select("doc_id", "pos", F.xxhash64(*[F.col(f"x.h{k}") for k in range(n)]).alias("g"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, ix, text: blocks between blank lines, trimmed, empty ones left out."""
    blocks = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(blocks).alias("ix", "text"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, ix, text by the simple rule."""
    return docs.select("doc_id", F.posexplode(T.simple_sentences(F.coalesce("text", F.lit("")))).alias("ix", "text"))
