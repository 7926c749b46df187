"""Rate limits, paced budgets, quotas and breakers over logs of requests, as batch jobs and as streams.

Batch forms order each visitor's rows with a window, or fold over sorted partitions with one small state (`folded`), so a hot
visitor costs time but no memory. Logs of services, of which one may have most rows, are cut into blocks of rows by (service,
time) whatever the service (`blocked`): a first pass sums a block up, the summaries are put together in order (sums and maxima
for paced requests, the failing tail for breakers, a step function for fallbacks), and a second pass does each block from the
state it starts in. Tasks so grow with the blocks, not with services. Stream forms keep one small state for each key, with a
timer or a watermark that ends it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.tables import stored, table

#: Rows of a block, about.
BLOCK = 100_000


def millis(df: DataFrame, column: str = "ts") -> Column:
    """Milliseconds since 1970; a time without zone counts as UTC, whatever the session's zone is."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp"))
    return F.unix_millis(F.col(column))


def fixed_window(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """requests (visitor, ts, id) with allowed, remaining and retry_ms: `limit` in each aligned window."""
    at = millis(requests)
    w = F.floor(at / (seconds * 1000))
    n = F.row_number().over(W.partitionBy("visitor", "window").orderBy("ts", "id"))
    r = requests.withColumn("window", w).withColumn("n", n)
    ok = F.col("n") <= limit
    return r.select("visitor", "ts", "id", ok.alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"), F.when(ok, F.lit(0).cast("long")).otherwise((F.col("window") + 1) * seconds * 1000 - at).alias("retry_ms"))


def folded(rows: DataFrame, keys: tuple[str, ...], begin: Callable[[], list], step: Callable[..., tuple], out: str) -> DataFrame:
    """keys, id and the columns of `out` (names with types): step(state, ms, id's row of further columns) for each row in order
    of (ms, id), with a fresh state for each key. rows: keys, ms, id, further columns. One pass over sorted batches."""
    extra = [c for c in rows.columns if c not in (*keys, "ms", "id")]
    kept = [f"{c} {dict(rows.dtypes)[c]}" for c in (*keys, "id")]
    names = [*keys, "id", *(x.split()[0] for x in out.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            got = []
            for *key, ms, _, x in zip(*cols[: len(keys)], cols[len(keys)], cols[len(keys) + 1], zip(*cols[len(keys) + 2 :]) if extra else [()] * b.num_rows, strict=True):
                if state is None or key != last:
                    last, state = key, begin()
                got.append(step(state, ms, *x))
            made = [pa.array(c) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], b.columns[len(keys) + 1], *made], names=names)

    ordered = rows.select(*keys, "ms", "id", *extra).repartition(*keys).sortWithinPartitions(*keys, "ms", "id")
    return ordered.mapInArrow(run, ", ".join([*kept, out]))


def anchored_window(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """visitor, id, allowed, retry_ms: the window opens with a visitor's first request; refused requests don't prolong it."""

    def step(state: list, ms: int) -> tuple:
        if state[0] is None or state[0] <= ms:
            state[:] = [ms + seconds * 1000, 1]
            return True, 0
        if state[1] >= limit:
            return False, state[0] - ms
        state[1] += 1
        return True, 0

    return folded(requests.select("visitor", "id", millis(requests).alias("ms")), ("visitor",), lambda: [None, 0], step, "allowed boolean, retry_ms long")


def blocked(log: DataFrame, rows: int = BLOCK) -> DataFrame:
    """A stored log (service, ms, id, ...) with `block`: blocks follow each other in the order of (service, ms, id)."""
    n = log.count()
    cut = log.repartitionByRange(max(1, -(-n // rows)), "service", "ms", "id")
    return stored(cut.withColumn("block", F.spark_partition_id()), "log-blocks")


IN_BLOCK = ("service", "block")


def paced(requests: DataFrame, apart_ms: int, most: int, block: int = BLOCK) -> DataFrame:
    """service, id, n, ms, start_ms: requests go one at a time, apart_ms apart; those past the first `most` of a service are refused (null).

    start(i) is the greatest of arrival(j) + (i - j) apart over j up to i: a running maximum. A block's summary is its number
    of rows and its greatest arrival(j) - j apart."""
    log = blocked(requests.select("service", "id", millis(requests).alias("ms")), block)
    order = W.partitionBy(*IN_BLOCK).orderBy("ms", "id")
    r = log.withColumn("k", (F.row_number().over(order) - 1).cast("long")).withColumn("lead", F.max(F.col("ms") - F.col("k") * apart_ms).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = r.groupBy(*IN_BLOCK).agg(F.count("*").alias("rows"), F.max("lead").alias("best"))
    before = W.partitionBy("service").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    sums = sums.withColumn("carried", F.max(F.col("best") - F.col("first") * apart_ms).over(before)).select(*IN_BLOCK, "first", "carried")
    r = r.join(sums, list(IN_BLOCK)).withColumn("n", F.col("first") + F.col("k"))
    lead = F.greatest(F.col("lead") - F.col("first") * apart_ms, "carried")
    return r.select("service", "id", "n", "ms", F.when(F.col("n") < most, lead + F.col("n") * apart_ms).alias("start_ms"))


def daily_quota(spends: DataFrame, most: int) -> DataFrame:
    """visitor, day, id, accepted, used: words are counted by UTC day; a request that would pass the quota is refused and not counted."""

    def step(state: list, ms: int, words: int) -> tuple:
        ok = state[0] + (words or 0) <= most
        state[0] += (words or 0) if ok else 0
        return ok, state[0]

    s = spends.select("visitor", F.date_format("ts", "yyyy-MM-dd").alias("day"), "id", millis(spends).alias("ms"), "words")
    return folded(s, ("visitor", "day"), lambda: [0], step, "accepted boolean, used long")


def route_limits(routes: DataFrame, per_minute: int) -> DataFrame:
    return routes.select("route", "weight", F.greatest(F.lit(1), F.floor(F.lit(per_minute) * F.col("weight"))).cast("int").alias("limit"))


def breaker(attempts: DataFrame, most: int = 4, block: int = BLOCK) -> DataFrame:
    """service, stopped_ms, times: when a service has failed `most` times in a row for the first time (attempts: service, ts, id, ok).

    A block's summary is its number of rows, whether any of them went well, and the failures at its end."""
    log = blocked(attempts.select("service", "id", millis(attempts).alias("ms"), F.coalesce("ok", F.lit(False)).alias("ok")), block)
    order = W.partitionBy(*IN_BLOCK).orderBy("ms", "id")
    a = log.withColumn("island", F.count_if("ok").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    a = a.withColumn("run", F.count_if(~F.col("ok")).over(W.partitionBy(*IN_BLOCK, "island").orderBy("ms", "id").rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = a.groupBy(*IN_BLOCK).agg(F.count("*").alias("rows"), F.bool_or("ok").alias("well"), F.max_by("run", F.struct("ms", "id")).alias("tail"))
    upto = W.partitionBy("service").orderBy("block")
    sums = sums.withColumn("end", F.sum("rows").over(upto))
    # failures carried in: those at the end of the last block that had a success, and all rows since
    sums = sums.withColumn("carried", F.col("end") - F.col("rows") + F.coalesce(F.last(F.when(F.col("well"), F.col("tail") - F.col("end")), True).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    a = a.where("not ok").join(sums.select(*IN_BLOCK, "carried"), list(IN_BLOCK))
    run = F.col("run") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)
    return a.where(run == most).groupBy("service").agg(F.min("ms").alias("stopped_ms"), F.count("*").alias("times"))


def cooldown_steps(failed_ms: np.ndarray, cooldown_ms: int) -> tuple[list[int], list[int]]:
    """A block's map from the time until which the primary is left alone to that time at its end: (last failures of a step, results).

    A block that starts with `until` first trips at its first failure from then on; what follows depends on that failure only."""
    follows = np.searchsorted(failed_ms, failed_ms + cooldown_ms).tolist()
    times, ends = failed_ms.tolist(), [0] * len(failed_ms)
    for i in range(len(times) - 1, -1, -1):
        ends[i] = ends[follows[i]] if follows[i] < len(times) else times[i] + cooldown_ms
    last = [i for i in range(len(times)) if i + 1 == len(times) or ends[i + 1] != ends[i]]
    return [times[i] for i in last], [ends[i] for i in last]


def with_fallback(checks: DataFrame, cooldown_ms: int = 30_000, block: int = BLOCK) -> DataFrame:
    """service, id, used: 'primary' or 'fallback'. A failed primary is left alone for a while (checks: service, ts, id, ok)."""
    log = blocked(checks.select("service", "id", millis(checks).alias("ms"), F.coalesce("ok", F.lit(False)).alias("ok")), block)
    kind = dict(log.dtypes)["service"]

    def sum_up(key: tuple, t: pa.Table) -> pa.Table:
        froms, ends = cooldown_steps(np.sort(t.column("ms").to_numpy()), cooldown_ms)
        one = pa.list_(pa.int64())
        return pa.table({"service": t.column("service").slice(0, 1), "block": t.column("block").slice(0, 1), "froms": pa.array([froms], one), "ends": pa.array([ends], one)})

    steps = log.where("not ok").select(*IN_BLOCK, "ms").groupBy(*IN_BLOCK).applyInArrow(sum_up, f"service {kind}, block int, froms array<long>, ends array<long>")
    all_ = log.select(*IN_BLOCK).distinct().join(steps, list(IN_BLOCK), "left")
    of = all_.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("froms", F.array().cast("array<long>")).alias("froms"), F.coalesce("ends", F.array().cast("array<long>")).alias("ends")))).alias("xs"))

    def apply(acc: Column, x: Column) -> Column:
        at = F.size(F.filter(x["froms"], lambda f: f < acc["until"])) + 1
        out = F.coalesce(F.try_element_at(x["ends"], at), acc["until"])
        return F.struct(out.alias("until"), F.array_append(acc["held"], F.struct(x["block"].alias("block"), acc["until"].alias("until"))).alias("held"))

    start = F.struct(F.lit(-1).cast("long").alias("until"), F.array().cast("array<struct<block:int,until:long>>").alias("held"))
    starts = of.select("service", F.explode(F.aggregate("xs", start, apply)["held"]).alias("h")).select("service", "h.block", "h.until")

    def step(state: list, ms: int, ok: bool, until: int) -> tuple:
        if not state:
            state.append(until)
        if ms >= state[0] and ok:
            return ("primary",)
        if ms >= state[0]:
            state[0] = ms + cooldown_ms
        return ("fallback",)

    return folded(log.join(starts, list(IN_BLOCK)).select(*IN_BLOCK, "ms", "id", "ok", "until"), IN_BLOCK, list, step, "used string").drop("block")


# streams


def counts_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """visitor, window, requests, denied of a stream: a tumbling count that closes a second after its window."""
    w = requests.withWatermark("ts", f"{seconds + 1} seconds").groupBy(F.window("ts", f"{seconds} seconds"), "visitor").agg(F.count("*").alias("requests"))
    return w.select("visitor", F.col("window.start").alias("window"), "requests", F.greatest(F.lit(0).cast("long"), F.col("requests") - limit).alias("denied"))


def anchored_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """visitor, id, allowed of a stream: the state of a visitor is (window's end, count) and ends once the watermark, a window
    behind the latest request, passes the window's end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, count = state.get if state.exists else (-1, 0)
        for g in groups:
            rows = []
            for t, i in g.sort_values(["ms", "id"])[["ms", "id"]].itertuples(index=False):
                if reset <= t:
                    reset, count = t + seconds * 1000, 0
                rows.append((key[0], i, count < limit))
                count += count < limit
            yield pd.DataFrame(rows, columns=["visitor", "id", "allowed"])
        if reset > state.getCurrentWatermarkMs():
            state.update((int(reset), int(count)))
            state.setTimeoutTimestamp(int(reset))
        elif state.exists:
            state.remove()

    late = requests.withWatermark("ts", f"{seconds} seconds").withColumn("ms", F.unix_millis("ts"))
    return late.groupBy("visitor").applyInPandasWithState(run, "visitor long, id long, allowed boolean", "reset long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """visitor, start, requests: sessions that end after a gap; works on streams that have a watermark too."""
    return requests.groupBy(F.session_window("ts", gap).alias("s"), "visitor").agg(F.count("*").alias("requests")).select("visitor", F.col("s.start").alias("start"), "requests")


# queries


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("visitor"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("service"), F.col("value").cast("int").alias("words"), (F.col("event_type") != "error").alias("ok"))


MS = "(epoch_us(ts) // 1000)"


def s01(spark, sf_dir):
    return fixed_window(_events(spark, sf_dir), 2, 43_200)


S01 = f"""WITH r AS (SELECT user_id AS visitor, ts, event_id AS id, {MS} // 43200000 AS w FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY visitor, w ORDER BY ts, id) AS n FROM r)
SELECT visitor, ts, id, n <= 2 AS allowed, greatest(0, 2 - n)::INT AS remaining, CASE WHEN n <= 2 THEN 0 ELSE (w + 1) * 43200000 - {MS} END AS retry_ms FROM n"""


def s02(spark, sf_dir):
    return anchored_window(_events(spark, sf_dir), 2, 86_400)


S02 = f"""WITH RECURSIVE r AS (SELECT user_id AS visitor, event_id AS id, {MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(visitor, id, n, reset, c, allowed, retry_ms) AS (SELECT visitor, id, n, ms + 86400000, 1, true, 0::BIGINT FROM r WHERE n = 1
 UNION ALL SELECT r.visitor, r.id, r.n, CASE WHEN f.reset <= r.ms THEN r.ms + 86400000 ELSE f.reset END, CASE WHEN f.reset <= r.ms THEN 1 WHEN f.c >= 2 THEN f.c ELSE f.c + 1 END, f.reset <= r.ms OR f.c < 2, CASE WHEN f.reset <= r.ms OR f.c < 2 THEN 0 ELSE f.reset - r.ms END FROM f JOIN r ON r.visitor = f.visitor AND r.n = f.n + 1)
SELECT visitor, id, allowed, retry_ms FROM f"""


def s03(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("service", F.concat(F.lit("s"), (F.col("visitor") % 5).cast("string")))
    return with_fallback(e, 6 * 3_600_000)


S03 = f"""WITH RECURSIVE r AS (SELECT 's' || (user_id % 5) AS service, event_id AS id, {MS} AS ms, event_type != 'error' AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
f(service, id, n, until, used) AS (SELECT service, id, n, CASE WHEN ok THEN -1 ELSE ms + 21600000 END, CASE WHEN ok THEN 'primary' ELSE 'fallback' END FROM r WHERE n = 1
 UNION ALL SELECT r.service, r.id, r.n, CASE WHEN r.ms >= f.until AND NOT r.ok THEN r.ms + 21600000 ELSE f.until END, CASE WHEN r.ms >= f.until AND r.ok THEN 'primary' ELSE 'fallback' END FROM f JOIN r ON r.service = f.service AND r.n = f.n + 1) SELECT service, id, used FROM f"""


def s04(spark, sf_dir):
    return paced(_events(spark, sf_dir), 3_600_000, 100)


S04 = f"""WITH r AS (SELECT event_type AS service, event_id AS id, {MS} AS ms, row_number() OVER (PARTITION BY event_type ORDER BY {MS}, event_id) - 1 AS n FROM events)
SELECT service, id, n, ms, CASE WHEN n < 100 THEN max(ms - n * 3600000) OVER (PARTITION BY service ORDER BY ms, id ROWS UNBOUNDED PRECEDING) + n * 3600000 END AS start_ms FROM r"""


def s05(spark, sf_dir):
    return daily_quota(_events(spark, sf_dir), 500)


S05 = f"""WITH RECURSIVE r AS (SELECT user_id AS visitor, strftime(ts, '%Y-%m-%d') AS day, event_id AS id, trunc(value)::INT AS words, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY {MS}, event_id) AS n FROM events),
f(visitor, day, id, n, accepted, used) AS (SELECT visitor, day, id, n, words <= 500, CASE WHEN words <= 500 THEN words ELSE 0 END FROM r WHERE n = 1
 UNION ALL SELECT r.visitor, r.day, r.id, r.n, f.used + r.words <= 500, CASE WHEN f.used + r.words <= 500 THEN f.used + r.words ELSE f.used END FROM f JOIN r ON r.visitor = f.visitor AND r.day = f.day AND r.n = f.n + 1) SELECT visitor, day, id, accepted, used FROM f"""
ROUTES = (("overlap", 0.5), ("detect", 1.0), ("figures", 2.0), ("report", 0.1), ("tiny", 0.01))


def s06(spark, sf_dir):
    """Routes of our own, and event types with their share of all events as weight."""
    e = table(spark, sf_dir, "events")
    n = e.count()
    seen = e.groupBy(F.concat(F.lit("type "), "event_type").alias("route")).agg((F.count("*") / F.lit(n)).alias("weight"))
    return route_limits(spark.createDataFrame(list(ROUTES), "route string, weight double").unionByName(seen), 30)


def s09(spark, sf_dir):
    return breaker(_events(spark, sf_dir).withColumn("service", F.concat(F.lit("s"), (F.col("visitor") % 5).cast("string"))), 3)


S09 = f"""WITH a AS (SELECT 's' || (user_id % 5) AS service, ts, event_id AS id, event_type != 'error' AS ok, {MS} AS ms FROM events), i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY service ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY service, island ORDER BY ts, id) AS run FROM i WHERE NOT ok) SELECT service, min(ms) AS stopped_ms, count(*) AS times FROM r WHERE run = 3 GROUP BY service"""


def s10(spark, sf_dir):
    return sessions(_events(spark, sf_dir), "12 hours")


S10 = """WITH e AS (SELECT user_id AS visitor, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY visitor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT visitor, min(ts) AS start, count(*) AS requests FROM s GROUP BY visitor, s"""

QUERIES = {"s01_fixed_window": s01, "s02_anchored_window": s02, "s03_fallback": s03, "s04_paced": s04, "s05_daily_quota": s05, "s06_route_limits": s06, "s09_breaker": s09, "s10_sessions": s10}
ORACLES = {
    "s01_fixed_window": S01, "s02_anchored_window": S02, "s03_fallback": S03, "s04_paced": S04, "s05_daily_quota": S05, "s09_breaker": S09, "s10_sessions": S10,
    "s06_route_limits": "SELECT route, weight::DOUBLE AS weight, greatest(1, floor(30 * weight))::INT AS \"limit\" FROM (VALUES " + ", ".join(f"('{r}', {w})" for r, w in ROUTES) + ") v(route, weight) UNION ALL SELECT 'type ' || event_type, count(*) / (SELECT count(*) FROM events), greatest(1, floor(30 * count(*) / (SELECT count(*) FROM events)))::INT FROM events GROUP BY event_type",
}
