"""Streams over the events' files give what the batch forms give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from inkwell.streaming import limits as S


def _stream(spark, tmp_path, small, parts=1):
    e = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("visitor"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    folder = str(tmp_path / "in")
    e.orderBy("ts").coalesce(parts).write.parquet(folder)
    return e, spark.readStream.schema(e.schema).parquet(folder)


def _drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        return df.sparkSession.table(name).toPandas()
    finally:
        q.stop()


def test_anchored_stream_agrees_with_the_batch(spark, tmp_path, small):
    batch, stream = _stream(spark, tmp_path, small)
    got = _drain(S.anchored_stream(stream, 2, 86_400), "anchored")
    want = S.anchored_window(batch, 2, 86_400).select("visitor", "id", "allowed").toPandas()
    order = lambda d: d.sort_values("id").reset_index(drop=True).astype({"allowed": bool})
    pd.testing.assert_frame_equal(order(got), order(want))


def test_counts_stream_in_complete_mode(spark, tmp_path, small):
    batch, stream = _stream(spark, tmp_path, small)
    got = _drain(S.counts_stream(stream, 2, 43_200), "counts", "complete")
    assert got.requests.sum() == batch.count()
    denied = S.fixed_window(batch, 2, 43_200).where("not allowed").count()
    assert got.denied.sum() == denied
