"""Copies that went through a translation: sentences' renderings make a shadow text, what is found there goes back to the sentences.

Renderings come as a table (doc_id, ix, english), one row a sentence, from whatever translated them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import overlap as O
from inkwell.operators.tokens import sentences


def shadow(renderings: DataFrame) -> DataFrame:
    """doc_id, text: each document's renderings in order; sentences without one leave no trace."""
    kept = renderings.where(F.trim("english") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", F.trim("english").alias("english")))).alias("es"))
    return kept.select("doc_id", F.array_join(F.transform("es", lambda e: e["english"]), " ").alias("text"))


def places(renderings: DataFrame) -> DataFrame:
    """doc_id, ix, first, last: the words of the shadow that a sentence's rendering has (last exclusive)."""
    n = renderings.where(F.trim("english") != "").select("doc_id", "ix", T.word_count(F.col("english")).cast("long").alias("n"))
    upto = F.sum("n").over(W.partitionBy("doc_id").orderBy("ix"))
    return n.select("doc_id", "ix", (upto - F.col("n")).alias("first"), upto.alias("last"))


def translated_copies(docs: DataFrame, renderings: DataFrame, sources: DataFrame, min_run: int = 6, threshold: float = 0.6) -> DataFrame:
    """doc_id, ix, text, english, source_id, similarity: sentences whose rendering a source has, word for word (1) or in its concepts.

    Runs of the shadow may cross sentences; every sentence that a run touches counts. The best source of a sentence stays, the one
    with the least id on ties."""
    s = shadow(renderings)
    runs = O.bridged_runs(O.seed_hits(s, sources), s, min_run).where(F.col("end") - F.col("start") >= min_run).select("doc_id", "source_id", "start", "end")
    exact = runs.join(places(renderings), "doc_id").where((F.col("first") < F.col("end")) & (F.col("last") > F.col("start"))).select("doc_id", "ix", "source_id", F.lit(1.0).alias("similarity"))
    rendered = renderings.where(F.trim("english") != "").select("doc_id", "ix", F.col("english").alias("text"))
    free = O.paraphrases(rendered, sentences(sources.select(F.col("source_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "source_id"), threshold)
    both = exact.unionByName(free.select("doc_id", "ix", "source_id", "similarity"))
    best = both.groupBy("doc_id", "ix").agg(F.min_by(F.struct("source_id", "similarity"), F.struct(-F.col("similarity"), F.col("source_id"))).alias("b"))
    own = sentences(docs).select("doc_id", "ix", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return best.join(own, ["doc_id", "ix"]).join(renderings.select("doc_id", "ix", "english"), ["doc_id", "ix"]).select("doc_id", "ix", "text", "english", "b.source_id", "b.similarity")
