"""Operator 3: mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A source's target is its share, by weight, of a total word budget; no target exceeds `most` times the source's size, and
what is cut off is shared again by weight until no target is above (`water_fill`, a closed form over sorted ratios). Inside
a source each size class (floor(log2(words))) gets expected copies e = min(most, lambda * g(class)), where g favours short
documents mildly and lambda makes the classes add up to the target. floor(e) copies of each document are certain; the
fraction p = e - floor(e) is its inclusion probability in a Pareto order sample: documents rank by
(u/(1-u)) / (p/(1-p)), u being a hash of the document, and the first of them are taken until the source's remaining words
are used. The one that would cross the budget stays out and a second pass fills what is left with short documents.

Hot sources: no window runs over a whole source. Ranks are binned, words are pre-aggregated per (source, bin), running sums
cover bins, and only the documents in the one bin where the budget ends are ranked exactly.

Defined cases: null text counts 0 words and is never taken; null source is a source of its own, last; equal ranks are
ordered by hash, then doc_id (nulls first); repeated rows are separate documents (equal ranks, so which of two identical
rows comes first doesn't matter); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.tables import stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BINS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(key: Column) -> Column:
    """A number in (0, 1) from a key's md5: 52 bits, moved half a step off zero."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def water_fill(groups: DataFrame, by: list[str], capacity: str, weight: str, total: str, key: list[str]) -> DataFrame:
    """Adds `filled` = min(capacity, lambda * weight), with lambda so that each `by` group adds up to its `total`.

    Groups are small aggregates (sources; size classes of a source)."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = part.orderBy("_ratio", *key)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = groups.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(0.0)))
    g = g.withColumn("_cap", F.coalesce(F.sum(capacity).over(upto) - F.col(capacity), F.lit(0)))
    g = g.withColumn("_left", F.sum(weight).over(everything) - F.sum(weight).over(upto) + F.col(weight))
    g = g.withColumn("_lambda", F.when(F.col("_left") > 0, (F.col(total) - F.col("_cap")) / F.col("_left")))
    # the first group in ratio order whose ratio is at least its lambda is the first that is not full
    g = g.withColumn("_level", F.min(F.when(F.col("_lambda") <= F.col("_ratio"), F.struct("_ratio", *key, "_lambda"))).over(everything)["_lambda"])
    full = F.col("_level").isNull() | (F.col("_ratio") < F.col("_level"))
    return g.withColumn("filled", F.when(full, F.col(capacity).cast("double")).otherwise(F.col("_level") * F.col(weight))).drop("_ratio", "_cap", "_left", "_lambda", "_level")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, words) aggregates: one row a source."""
    one = W.partitionBy(F.lit(0))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("_all", F.sum("source_size").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share))
    s = s.withColumn("_capacity", F.col("source_size") * most)
    return water_fill(s, [], "_capacity", "_w", "_all", ["source"]).select("source", "source_size", F.col("filled").alias("target"))


def _prefix(ranked: DataFrame, budgets: DataFrame, bins: int) -> DataFrame:
    """(source, doc key columns) of the first documents in rank order whose running words stay within the source's budget.

    ranked: _row, source, size, _rank, u, doc_id; budgets: source, budget."""
    b = ranked.withColumn("_bin", F.least(F.floor(F.col("_rank") / (F.col("_rank") + 1) * bins), F.lit(bins - 1)).cast("int"))
    per = b.groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    run = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("_upto", F.sum("_words").over(run))
    ends = per.join(budgets.select(F.col("source").alias("_s"), "budget"), F.col("source").eqNullSafe(F.col("_s"))).where("_upto > budget")
    ends = ends.groupBy(F.col("_s").alias("_s")).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_before"), "budget")).alias("_end"))
    b = b.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
    whole = b.where(F.col("_end").isNull() | (F.col("_bin") < F.col("_end._bin"))).select("_row")
    last = b.where(F.col("_bin") == F.col("_end._bin"))
    order = W.partitionBy("source").orderBy("_rank", "u", "doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("_upto", F.sum("size").over(order) + F.col("_end._before"))
    return whole.unionByName(last.where(F.col("_upto") <= F.col("_end.budget")).select("_row"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, bins: int = BINS, row: str | None = None) -> DataFrame:
    """One row a document: _row, doc_id, source, size, source_size, target, copies, taken. Reruns agree on any cluster.

    row names a column of unique row numbers; without one, rows are numbered here."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    base = docs.select(number.cast("long").alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"))
    base = stored(base.withColumn("u", unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix")
    classes = base.where("size > 0").withColumn("_class", F.length(F.bin("size")) - 1).groupBy("source", "_class").agg(F.sum("size").alias("size"))
    targets = stored(source_targets(base.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most), "mix-targets")
    c = classes.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    c = c.withColumn("_capacity", F.col("size") * most).withColumn("_w", F.col("size") / (1 + F.col("_class") / F.lit(8.0)))
    c = water_fill(c, ["source"], "_capacity", "_w", "target", ["_class"])
    c = c.withColumn("_e", F.least(F.col("filled") / F.col("size"), F.lit(float(most))))
    c = c.withColumn("sure", F.floor("_e").cast("long")).withColumn("p", F.col("_e") - F.floor("_e"))
    c = stored(c.select("source", "_class", "size", "target", "sure", "p"), "mix-classes")
    left = c.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("budget"))
    d = base.where("size > 0").withColumn("_class", F.length(F.bin("size")) - 1)
    at = c.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), "sure", "p")
    d = d.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))).drop("_s", "_c")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = d.select("_row", "doc_id", "source", "size", "u", "sure", F.when(F.col("p") > 0, odds).alias("_rank"))
    ranked = d.where(F.col("_rank").isNotNull() & (F.col("sure") < most))
    first = stored(_prefix(ranked, left, bins), "mix-first")
    # second pass: short documents that the first left out fill the rest
    used = ranked.join(first, "_row", "left_semi").groupBy("source").agg(F.sum("size").alias("_used"))
    gap = left.join(used.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("budget") - F.coalesce("_used", F.lit(0))).alias("budget"))
    gap = stored(gap, "mix-gap")
    small = ranked.join(first, "_row", "left_anti").join(gap.select(F.col("source").alias("_s"), (F.col("budget") / 8).alias("_most")), F.col("source").eqNullSafe(F.col("_s")))
    small = small.where(F.col("size") <= F.col("_most")).drop("_s", "_most")
    chosen = first.unionByName(_prefix(small, gap, bins)).withColumn("_one", F.lit(1))
    copies = d.join(chosen, "_row", "left").select("_row", (F.col("sure") + F.coalesce("_one", F.lit(0))).alias("copies"))
    out = base.join(copies, "_row", "left").join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    n = F.coalesce("copies", F.lit(0))
    return out.select("_row", "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), n.alias("copies"), (n * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns it came with."""
    held = docs.select(F.struct("*").alias("d")).withColumn("_row", F.monotonically_increasing_id())
    held = stored(held, "mix-docs")
    copies = mix(held.select("_row", "d.doc_id", "d.source", "d.text"), weights, share, most, row="_row").where("copies > 0").select("_row", "copies")
    return held.join(copies, "_row").select(F.explode(F.array_repeat("d", F.col("copies").cast("int"))).alias("d")).select("d.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
src1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         1.5 * sum(source_size) OVER () AS total FROM src0),
src2 AS (SELECT *, 2.0 * source_size / w AS ratio FROM src1),
src3 AS (SELECT *, (total - (sum(2 * source_size) OVER o - 2 * source_size)) / (sum(w) OVER () - sum(w) OVER o + w) AS lam
         FROM src2 WINDOW o AS (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING)),
src4 AS (SELECT *, min(CASE WHEN lam <= ratio THEN {'a': ratio, 'b': source, 'c': lam} END) OVER () AS lev FROM src3),
src AS (SELECT source, source_size, CASE WHEN lev IS NULL OR ratio < lev.c THEN 2.0 * source_size ELSE lev.c * w END AS target FROM src4),
cls0 AS (SELECT b.source, length(bin(b.size)) - 1 AS cls, sum(b.size)::BIGINT AS size, any_value(s.target) AS target
         FROM base b JOIN src s ON b.source IS NOT DISTINCT FROM s.source WHERE b.size > 0 GROUP BY 1, 2),
cls1 AS (SELECT *, size / (1 + cls / 8.0) AS w, 2 * size AS cap FROM cls0),
cls2 AS (SELECT *, cap / w AS ratio FROM cls1),
cls3 AS (SELECT *, (target - (sum(cap) OVER o - cap)) / (sum(w) OVER (PARTITION BY source) - sum(w) OVER o + w) AS lam
         FROM cls2 WINDOW o AS (PARTITION BY source ORDER BY ratio, cls ROWS UNBOUNDED PRECEDING)),
cls4 AS (SELECT *, min(CASE WHEN lam <= ratio THEN {'a': ratio, 'b': cls, 'c': lam} END) OVER (PARTITION BY source) AS lev FROM cls3),
cls5 AS (SELECT *, least((CASE WHEN lev IS NULL OR ratio < lev.c THEN cap::DOUBLE ELSE lev.c * w END) / size, 2.0) AS e FROM cls4),
cls AS (SELECT source, cls, size, target, floor(e)::BIGINT AS sure, e - floor(e) AS p FROM cls5),
budget AS (SELECT source, any_value(target) - sum(sure * size) AS budget FROM cls GROUP BY source),
d AS (SELECT b.doc_id, b.source, b.size, b.u, c.sure, CASE WHEN c.p > 0 AND c.sure < 2 THEN (b.u / (1 - b.u)) / (c.p / (1 - c.p)) END AS rank
      FROM base b JOIN cls c ON b.source IS NOT DISTINCT FROM c.source AND length(bin(b.size)) - 1 = c.cls WHERE b.size > 0),
r1 AS (SELECT d.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto, g.budget
       FROM d JOIN budget g ON d.source IS NOT DISTINCT FROM g.source WHERE rank IS NOT NULL),
gap AS (SELECT g.source, g.budget - coalesce(sum(r.size) FILTER (WHERE r.upto <= r.budget), 0) AS budget
        FROM budget g LEFT JOIN r1 r ON g.source IS NOT DISTINCT FROM r.source GROUP BY g.source, g.budget),
r2 AS (SELECT r.*, sum(r.size) OVER (PARTITION BY r.source ORDER BY rank, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto2, g.budget AS gap
       FROM r1 r JOIN gap g ON r.source IS NOT DISTINCT FROM g.source WHERE r.upto > r.budget AND r.size <= g.budget / 8),
chosen AS (SELECT doc_id FROM r1 WHERE upto <= budget UNION ALL SELECT doc_id FROM r2 WHERE upto2 <= gap)
SELECT b.doc_id, b.size, s.source_size, round(s.target, 6) AS target, b.source,
       coalesce(d.sure + (c.doc_id IS NOT NULL)::BIGINT, 0) * b.size AS taken, coalesce(d.sure + (c.doc_id IS NOT NULL)::BIGINT, 0) AS copies
FROM base b JOIN src s ON b.source IS NOT DISTINCT FROM s.source
LEFT JOIN d ON d.doc_id = b.doc_id LEFT JOIN chosen c ON c.doc_id = b.doc_id
"""

QUERIES = {"op3_source_mix": op3}
ORACLES = {"op3_source_mix": SQL}
