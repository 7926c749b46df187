"""Queries through the extension points: an operator called from SQL, a library read by spark.read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.plans.comparing import BRIDGED, p03
from inkwell.sources import extensions as E
from inkwell.tables import shared_dir, table


def e01(spark, sf_dir):
    """Exact runs of documents and benchmark items, joined by the table function in SQL."""
    E.register(spark)
    runs = p03(spark, sf_dir).withColumn("less", -F.col("end"))
    return spark.sql("SELECT * FROM bridged_runs(TABLE(SELECT * FROM {runs}) PARTITION BY (doc_id, source_id) ORDER BY (`start`, less, source_start), 2)", runs=runs)


def e02(spark, sf_dir):
    """Benchmark items written as a folder of texts, one each, and read back."""
    E.register(spark)
    path = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    back = spark.read.format("inkwell_library").load(path).where("kind in ('txt', 'md')")
    t = F.regexp_replace("text", "\n$", "")
    return back.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "kind", F.length(t).alias("chars"), F.md5(t.cast("binary")).alias("md5"))


QUERIES = {"e01_bridged_by_sql": e01, "e02_library_reader": e02}
ORACLES = {
    "e01_bridged_by_sql": f"""WITH RECURSIVE {BRIDGED} SELECT doc_id, source_id, r.s AS "start", r.e AS "end", r.ss AS source_start, r.w AS words FROM brl""",
    "e02_library_reader": "SELECT item_id, 'txt' AS kind, length(text) AS chars, md5(text) AS md5 FROM benchmark",
}
