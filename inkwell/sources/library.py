"""Documents of a folder or a request, result history, and searching a local corpus as search services are searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.tokens import ngrams, with_words
from inkwell.sources.latex import latex_text
from inkwell.sources.markup import decoded, file_kind

#: Words of a slice of an inverted index; a longer text is a slice of its own.
SLICE = 150_000


def folder(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, text: text, Markdown and LaTeX files under a folder of any store, read by Spark. Hidden files and read-mes are
    left out; kinds that need a parser of their own have null text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    f = f.select(name.alias("name"), "content").where(~F.col("name").rlike(r"(?i)^(?:\.|readme)"))
    kind = file_kind(F.col("name"), F.col("content"))
    text = F.when(kind.isin("txt", "md"), decoded(F.col("content"))).otherwise(latex_text(F.when(kind == "tex", decoded(F.col("content")))))  # other kinds reach the UDF as null
    return f.select("name", kind.alias("kind"), text.alias("text"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """text, label ('human' or 'ai'), source of evaluation rows, one JSON object a line; lines without a text or with another label,
    and lines that are no JSON, are left out."""
    rows = spark.read.schema("text string, label string, source string").json(path)
    return rows.where((F.trim("text") != "") & F.col("label").isin("human", "ai")).select("text", "label", F.coalesce("source", F.lit("")).alias("source"))


def uploads(docs: DataFrame, most: int = 20, chars: int = 800_000, title: int = 200) -> DataFrame:
    """A request's documents (request, ix, title, text): the first `most`, while they hold up to `chars` characters."""
    order = W.partitionBy("request").orderBy("ix")
    d = docs.where(F.trim("text") != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    upto = F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("upto", upto).where(F.col("upto") <= chars).select("request", "ix", F.left("title", F.lit(title)).alias("title"), "text")


def history_key(tool, text):
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.sha2(F.concat(tool, F.lit("\n"), clean).cast("binary"), 256)


def latest_results(history: DataFrame) -> DataFrame:
    """The latest result of each key (key, created, result)."""
    return history.groupBy("key").agg(F.max("created").alias("created"), F.max_by("result", F.struct("created", "result")).alias("result"))


def inverted_index(texts: DataFrame) -> DataFrame:
    """id, index map<string, array<int>>: the places of each word between single blanks (texts: id, text), made in the scan's tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b.column("w"))))]).astype(np.int64)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
                d = b.column("w").slice(i, j - i).flatten().dictionary_encode()
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                code = np.asarray(d.indices).astype(np.int64)
                order = np.lexsort((code, row))  # stable: places stay in order
                place = (np.arange(len(code)) - (at[i:j] - at[i])[row])[order].astype(np.int32)
                code, row = code[order], row[order]
                head = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                places = pa.ListArray.from_arrays(pa.array(np.append(head, len(code)).astype(np.int32)), pa.array(place))
                words = d.dictionary.take(pa.array(code[head]))
                maps = pa.MapArray.from_arrays(pa.array(np.searchsorted(row[head], np.arange(j - i + 1)).astype(np.int32)), words, places)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), maps], ["id", "index"])
                i = j

    w = texts.select("id", F.split(F.coalesce("text", F.lit("")), " ", -1).alias("w"))
    return w.mapInArrow(run, f"id {w.schema['id'].dataType.simpleString()}, index map<string,array<int>>")


def from_inverted_index(index: DataFrame) -> DataFrame:
    """id, text of (id, index map<string, array<int>>): words put back at their places, in each row by itself."""
    at = F.flatten(F.transform(F.map_entries("index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("word")))))
    return index.select("id", F.array_join(F.transform(F.array_sort(at), lambda x: x["word"]), " ").alias("text"))


def phrase_search(phrases: DataFrame, corpus: DataFrame, most: int = 3) -> DataFrame:
    """query, source_id: texts (source_id, text) that hold a phrase (query, phrase) word for word, the first `most` by id.

    Phrases meet texts in an equi-join on their first three words, and are then compared whole; phrases under three words
    find nothing."""
    p = phrases.select("query", T.words(F.col("phrase")).alias("p")).where(F.size("p") >= 3).withColumn("gram", F.array_join(F.slice("p", 1, 3), " "))
    g = ngrams(corpus.select(F.col("source_id").alias("doc_id"), "text"), 3)
    hit = p.join(g, "gram").join(with_words(corpus.select(F.col("source_id").alias("doc_id"), "text")), "doc_id")
    hit = hit.where(F.slice("words", F.col("pos") + 1, F.size("p")) == F.col("p")).select("query", F.col("doc_id").alias("source_id")).distinct()
    return hit.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("source_id"))).where(F.col("r") <= most).drop("r")


def keyword_search(queries: DataFrame, corpus: DataFrame, most: int = 10, all_words: bool = False) -> DataFrame:
    """query, source_id, shared: texts that share most distinct keywords (query, keywords); all_words: only those with all."""
    k = queries.select("query", F.explode(F.array_distinct(T.words(F.col("keywords")))).alias("word"))
    n = k.groupBy("query").agg(F.count("*").alias("n"))
    w = with_words(corpus.select(F.col("source_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("source_id"), F.explode(F.array_distinct("words")).alias("word"))
    s = w.join(k, "word").groupBy("query", "source_id").agg(F.count("*").alias("shared")).join(n, "query")
    s = s.where(F.col("shared") == F.col("n")) if all_words else s
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("shared"), "source_id"))
    return s.withColumn("r", r).where(F.col("r") <= most).select("query", "source_id", "shared")
