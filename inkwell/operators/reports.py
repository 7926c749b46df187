"""Reports: action lists, overviews, paragraph statistics, numbered findings, provider statistics, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T

#: Order of severity, of levels and of the kinds of findings.
SEVERITY = ("error", "warning", "info")
LEVELS = ("high", "medium", "low")


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0)), F.lit(len(order) + 1))


def issue_level(kind: Column, words: Column) -> Column:
    return F.when(kind.isin("copied_uncited", "disguised", "tortured", "translated") | ((kind == "copied_cited") & (words >= 15)), "high").otherwise("medium")


def action_list(issues: DataFrame, each: int = 5) -> DataFrame:
    """doc_id, place, level, kind, title: what to look at first, from issues (doc_id, kind, start, words). Of each kind the `each`
    longest are listed; the rest is one line. Reworded and cited, and repeated passages are left out."""
    i = issues.where(~F.col("kind").isin("reworded_cited", "repeated"))
    i = i.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy(F.desc("words"), "start")))
    shown = i.where(F.col("n") <= each).select("doc_id", issue_level(F.col("kind"), F.col("words")).alias("level"), "kind", "start", F.concat("kind", F.lit(": "), F.col("words").cast("string"), F.lit(" words")).alias("title"))
    more = i.where(F.col("n") > each).groupBy("doc_id").agg(F.count("*").alias("k"))
    more = more.select("doc_id", F.lit("medium").alias("level"), F.lit("more").alias("kind"), F.lit(None).cast("long").alias("start"), F.concat(F.col("k").cast("string"), F.when(F.col("k") == 1, " more passage to fix").otherwise(" more passages to fix")).alias("title"))
    a = shown.unionByName(more)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(rank_of(F.col("level"), LEVELS), (F.col("kind") == "more").cast("int"), "kind", "start"))
    return a.select("doc_id", place.alias("place"), "level", "kind", "title")


def overview(facts: DataFrame) -> DataFrame:
    """doc_id, tool, status, headline from a row of facts for each document: similarity, verdict, reworded, uncited_words, serious,
    ai_verdict, ai_score, ai_low, ai_high, references, missing, mismatched, claims, words, grammar_score, grammar_issues, grammar_errors."""
    c = F.col
    plural = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    overlap = F.when((c("verdict") == "high") | c("serious"), "attention").when((c("verdict") == "moderate") | (c("reworded") >= 5) | (c("uncited_words") > 0), "review").otherwise("ok")
    ai = F.when(c("ai_verdict") == "likely_ai", "attention").when(c("ai_verdict") == "uncertain", "review").when(c("ai_verdict") == "insufficient_text", "skipped").otherwise("ok")
    ai_line = F.when(c("ai_verdict") == "insufficient_text", "Not enough text to judge.").otherwise(F.format_string("Pattern score %d (plausible range %d to %d).", "ai_score", "ai_low", "ai_high"))
    none = (c("references") == 0) & (c("words") >= 1000)
    cites = F.when(none, "review").when(c("mismatched") > 0, "attention").when((c("missing") > 0) | (c("claims") > 0), "review").otherwise("ok")
    cite_line = F.when(none, F.concat(F.lit("No reference list was found in "), c("words").cast("string"), F.lit(" words."))).otherwise(F.concat(plural(c("references"), "reference"), F.lit(", "), plural(c("claims"), "claim"), F.lit(" that may need a citation.")))
    grammar = F.when(c("grammar_score") >= 85, "ok").when(c("grammar_score") >= 65, "review").otherwise("attention")
    rows = [
        ("overlap", overlap, F.concat(F.format_string("%.1f%% of words match", "similarity"), F.when(c("uncited_words") > 0, F.concat(F.lit(" ("), c("uncited_words").cast("string"), F.lit(" words copied without a citation)"))).otherwise(""), F.lit("."))), ("detector", ai, ai_line), ("citations", cites, cite_line),
        ("grammar", grammar, F.concat(plural(c("grammar_issues"), "issue"), F.lit(" ("), plural(c("grammar_errors"), "likely error"), F.lit(")."))),
    ]
    return facts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), s.alias("status"), h.alias("headline")) for t, s, h in rows])).alias("o")).select("doc_id", "o.*")


def paragraph_stats(docs: DataFrame, spans: DataFrame, least: int = 8) -> DataFrame:
    """doc_id, ix, words, copied: the share of each paragraph's words inside spans (doc_id, start, end, word places of the text)."""
    blocks = F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n")
    p = docs.select("doc_id", F.posexplode(F.transform(blocks, T.word_count)).alias("ix", "words"))
    before = F.sum("words").over(W.partitionBy("doc_id").orderBy("ix").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    p = p.withColumn("from", before).where(F.col("words") >= least)
    over = F.greatest(F.lit(0), F.least(F.col("from") + F.col("words"), F.col("end")) - F.greatest("from", F.col("start")))
    c = p.join(spans.select("doc_id", "start", "end"), "doc_id").withColumn("c", over).groupBy("doc_id", "ix").agg(F.sum("c").alias("c"))
    return p.join(c, ["doc_id", "ix"], "left").select("doc_id", "ix", "words", F.round(F.coalesce("c", F.lit(0)) / F.col("words"), 6).alias("copied"))


def numbered(findings: DataFrame) -> DataFrame:
    """findings (doc_id, category, start, end) with n: numbers in reading order; grammar notes have none."""
    order = W.partitionBy("doc_id").orderBy("start", "end", "category").rowsBetween(W.unboundedPreceding, W.currentRow)
    return findings.withColumn("n", F.when(F.col("category") != "grammar", F.count_if(F.col("category") != "grammar").over(order)))


def provider_stats(attempts: DataFrame) -> DataFrame:
    """provider, queries, failures, documents of an attempt log (provider, ok, documents)."""
    return attempts.groupBy("provider").agg(F.count("*").alias("queries"), F.count_if(~F.col("ok")).alias("failures"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


def rewrite_targets(spans: DataFrame, most: int = 2) -> DataFrame:
    """The longest spans of each document."""
    r = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("words"), "start"))
    return spans.withColumn("r", r).where(F.col("r") <= most).drop("r")


def markdown(overviews: DataFrame, actions: DataFrame) -> DataFrame:
    """doc_id, report: a Markdown report of overviews and action lists."""
    o = overviews.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- **"), "tool", F.lit("** ("), "status", F.lit("): "), "headline"))).alias("o"))
    a = actions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "level", "title"))).alias("a"))
    lines = F.transform(F.coalesce("a", F.array().cast("array<struct<place:int,level:string,title:string>>")), lambda x: F.concat(x["place"].cast("string"), F.lit(". ["), x["level"], F.lit("] "), x["title"]))
    todo = F.when(F.size(lines) > 0, F.concat(F.lit("\n\n## To do\n\n"), F.array_join(lines, "\n"))).otherwise("")
    return o.join(a, "doc_id", "left").select("doc_id", F.concat(F.lit("# Report\n\n## Overview\n\n"), F.array_join("o", "\n"), todo, F.lit("\n")).alias("report"))
