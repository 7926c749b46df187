"""Operator 11: sharding by balanced label propagation (DataFrame functions only).

Documents of one group (equal texts; `group` may name any other link) are neighbours; an edge is cut when they sit in
different shards. Law `bytes`: shards get nearly equal bytes.

Cells: a group's documents are dealt by their ids over at most CELLS cells, 64 a shard, and a cell's rows stay together. A
cell is a row of the propagation, so no group has more than CELLS rows there, whatever its size. Cells start in the shard
of their number, which scatters a group over all shards.

Rounds: a group's cells look at where their neighbours are. The shards with most of them are the group's homes: one, or as many as its bytes fill (capacity: an equal part of all bytes); when that
settles, the first with room for the whole group, or as many as have room for it together. Cells
elsewhere want to move to a home with room. Movers into a shard line up by gain (neighbours there minus neighbours here, in powers
of two) and then by hash bin, and are let in as long as running bytes stay within the shard's room and half of what is wished out of
it, or into it if that is less. Rounds end when less than
1/SETTLED of the linked bytes moves.

Evening out: shards that linked cells overfill give back those with fewest neighbours. These and the documents without
neighbours have no edge to lose: those larger than 1/LARGE of a shard, fewer than shards x LARGE by that, go to the lightest
shard one by one, largest first; the others lie in a row by hash and are cut where shards are filled to one level. Sizes so
differ by about one document of that bound, unless documents larger than a shard leave no choice.

Loads of the shards (one number each) are all that comes to the driver. Running sums go over bins first, then inside a bin.

Defined cases: null text counts as empty; a null doc_id is an id of its own; repeated rows each get a slot (those of one id
and text share a cell); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.tables import discard, stored, table

SHARDS = 24
CELLS_A_SHARD = 64
LARGE = 64
BINS = 4096
STEPS = 256
ROUNDS = 12
SETTLED = 2000
KEY = ("k1", "k2", "cell")


def sized(docs: DataFrame, shards: int, group: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, k1, k2 (group), cell."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    link = text if group is None else group
    cell = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(shards * CELLS_A_SHARD)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(link).alias("k1"), F.xxhash64(F.lit(7), link).alias("k2"), cell.alias("cell"))


def _upto(rows: DataFrame, part: list[str], value: str, bins: int, label: str) -> DataFrame:
    """Adds _before: the sum of `value` over the rows before in the order of KEY's hash, inside a part. rows are stored ones."""
    held = rows.withColumn("_bin", F.pmod(F.xxhash64("k1", "k2"), F.lit(bins)) if label == "pool" else F.pmod(F.xxhash64(*KEY), F.lit(bins)))
    per = held.groupBy(*part, "_bin").agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*part).orderBy("_bin") if part else W.partitionBy(F.lit(0)).orderBy("_bin")
    per = per.select(*[F.col(c).alias(f"_{c}") for c in part], F.col("_bin").alias("_b"), (F.sum("_sum").over(over) - F.col("_sum")).alias("_base"))
    at = F.col("_bin") == F.col("_b")
    for c in part:
        at &= F.col(c) == F.col(f"_{c}")
    inside = W.partitionBy(*part, "_bin").orderBy(*KEY).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
    return held.join(F.broadcast(per), at).withColumn("_before", F.col("_base") + F.col("_inside")).drop("_bin", "_b", "_base", "_inside", *[f"_{c}" for c in part])


def _loads(cells: DataFrame, shards: int) -> tuple[list[int], int]:
    """Bytes in each shard, and bytes that moved in the last round."""
    out, moved = [0] * shards, 0
    for r in cells.groupBy("shard").agg(F.sum("bytes").alias("b"), F.sum(F.when(F.col("moved"), F.col("bytes")).otherwise(0)).alias("m")).collect():
        out[r.shard] = r.b
        moved += r.m
    return out, moved


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def propagated(cells: DataFrame, loads: list[int], capacity: float, turn: int, swaps: bool) -> DataFrame:
    """One round: cells (k1, k2, cell, rows, bytes, shard, moved) with movers let in where there is room.

    swaps: homes are chosen as if other groups' cells would leave them, else by the room they have now."""
    room, free = _numbers([max(0, int(capacity) - x) for x in loads]), _numbers([int(capacity) - x for x in loads])
    held = cells.groupBy("k1", "k2", "shard").agg(F.sum("rows").alias("n"), F.sum("bytes").alias("b"))
    g = held.groupBy("k1", "k2").agg(F.sum("b").alias("all"), F.collect_list(F.struct("shard", "n", "b")).alias("at")).where(F.size("at") > 1)
    fits = lambda x: F.lit(int(capacity)).cast("long") if swaps else F.element_at(room, x["shard"] + 1) + x["b"]
    ranked = F.transform("at", lambda x: F.struct((fits(x) < F.col("all")).alias("tight"), (-x["n"]).alias("less"), F.xxhash64("k1", x["shard"]).alias("tie"), x["shard"].alias("shard"), fits(x).alias("fits"), x["n"].alias("n")))
    g = g.withColumn("at", F.array_sort(ranked))
    enough = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("n")), lambda acc, x: F.when(acc["held"] < F.col("all"), F.struct((acc["held"] + x["fits"]).alias("held"), (acc["n"] + 1).alias("n"))).otherwise(acc))["n"]
    roomy = lambda h: F.element_at(room, h + 1) * 100 > F.lit(float(capacity))
    g = g.withColumn("homes", F.transform(F.slice("at", F.lit(1), enough), lambda x: x["shard"])).withColumn("open", F.when((F.size("homes") > 1) & F.exists("homes", roomy), F.filter("homes", roomy)).otherwise(F.col("homes")))
    g = g.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "all", "homes", "open", F.map_from_entries(F.transform("at", lambda x: F.struct(x["shard"], x["n"]))).alias("n"))
    c = cells.join(g, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    away = F.col("homes").isNotNull() & ~F.array_contains("homes", F.col("shard"))
    c = c.withColumn("to", F.when(away, F.element_at("open", F.pmod(F.xxhash64("cell", F.lit(turn)), F.size("open")).cast("int") + 1)))
    gain = F.element_at("n", F.col("to")) - F.element_at("n", F.col("shard"))
    small = F.col("all") * STEPS < F.lit(float(capacity))
    step = F.pmod(F.when(small, F.xxhash64("k1", "k2", F.lit(turn))).otherwise(F.xxhash64(*KEY, F.lit(turn))), F.lit(STEPS))
    c = c.withColumn("place", F.when(F.col("to").isNotNull(), F.struct((-F.signum(gain) * F.floor(F.log2(F.abs(gain) + 1))).alias("level"), step.alias("step"))))
    c = c.select(*cells.columns, "to", "place")
    wish = c.where("to is not null").groupBy("shard", "to", "place").agg(F.sum("bytes").alias("b"))
    leaving = wish.groupBy(F.col("shard").alias("_from")).agg(F.sum("b").alias("leaving"))
    line = wish.groupBy("to", "place").agg(F.sum("b").alias("b"))
    line = line.withColumn("upto", F.sum("b").over(W.partitionBy("to").orderBy("place"))).withColumn("coming", F.sum("b").over(W.partitionBy("to")))
    line = line.join(F.broadcast(leaving), F.col("to") == F.col("_from"), "left")
    quota = F.greatest(F.lit(0), F.element_at(free, F.col("to") + 1) + F.least(F.coalesce("leaving", F.lit(0)), F.col("coming")) / 2)
    full = line.where(F.col("upto") > quota).groupBy(F.col("to").alias("_to")).agg(F.min("place").alias("end"))
    c = c.join(F.broadcast(full), F.col("to") == F.col("_to"), "left")
    moves = F.col("to").isNotNull() & (F.col("end").isNull() | (F.col("place") < F.col("end")))
    return c.select(*KEY, "rows", "bytes", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"), F.coalesce(moves, F.lit(False)).alias("moved"))


def settled(cells: DataFrame, capacity: float, shards: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Stored linked cells after the last round, and the shards' loads."""
    now = stored(cells, "shards-cells")
    loads, _ = _loads(now, shards)
    for swaps in (True, False):
        for turn in range(rounds):
            later = stored(propagated(now, loads, capacity, turn, swaps), "shards-cells")
            discard(now)
            now = later
            loads, moved = _loads(now, shards)
            if moved * SETTLED <= sum(loads):
                break
    return now, loads


def _overfull(cells: DataFrame, loads: list[int], capacity: float) -> DataFrame:
    """Cells with `out`: those of overfull shards beyond the capacity, fewest neighbours first."""
    held = cells.groupBy("k1", "k2", "shard").agg(F.sum("rows").alias("n")).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("shard").alias("_s"), "n")
    c = cells.where(F.col("shard").isin([s for s, x in enumerate(loads) if x > capacity]))
    c = c.join(held, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("shard") == F.col("_s"))).drop("_1", "_2", "_s")
    c = c.withColumn("place", F.struct((-F.floor(F.log2("n"))).alias("level"), F.pmod(F.xxhash64(*KEY), F.lit(BINS)).alias("step")))
    line = c.groupBy("shard", "place").agg(F.sum("bytes").alias("b")).withColumn("upto", F.sum("b").over(W.partitionBy("shard").orderBy("place")))
    ends = line.where(F.col("upto") > F.lit(float(capacity))).groupBy(F.col("shard").alias("_s")).agg(F.min("place").alias("end"))
    return c.join(F.broadcast(ends), F.col("shard") == F.col("_s")).where(F.col("place") >= F.col("end")).select(*KEY, "rows", "bytes")


def _one_by_one(large: DataFrame, loads: list[int]) -> DataFrame:
    """One row: out (array of key and shard) and loads after each large cell went to the lightest shard, largest first."""
    start = F.struct(_numbers(loads).cast("array<long>").alias("loads"), F.array().cast("array<struct<k1:long,k2:long,cell:int,shard:int>>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v)).alias("loads"),
            F.array_append(acc["out"], F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["cell"].alias("cell"), to.alias("shard"))).alias("out"),
        )

    all_of = large.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), *KEY, "bytes"))).alias("xs"))
    return all_of.select(F.aggregate("xs", start, put).alias("r")).select("r.*")


def level_of(loads: list[int], more: int) -> float:
    """The level to which `more` fills the lowest loads."""
    low = sorted(loads)
    total = more
    for n, x in enumerate(low, 1):
        total += x
        if n == len(low) or total <= low[n] * n:
            return total / n
    return 0.0


def _filled(pool: DataFrame, loads: list[int], capacity: float, shards: int) -> DataFrame:
    """k1, k2, cell, rows, shard of cells without edges to lose; pool is stored."""
    is_large = F.col("bytes") * LARGE > F.lit(float(capacity))
    first = stored(_one_by_one(pool.where(is_large), loads), "shards-large")
    loads = list(first.select("loads").first()[0])
    put = pool.where(is_large).join(F.broadcast(first.select(F.explode("out").alias("o")).select("o.*")), list(KEY)).select(*KEY, "rows", "shard")
    rest = pool.where(~is_large)
    level = level_of(loads, rest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    ends, end = [], 0.0
    for x in loads:
        end += max(0.0, level - x)
        ends.append(end)
    middle = F.col("_before") + F.col("bytes") / 2
    shard = F.least(F.size(F.filter(_numbers(ends), lambda e: e <= middle)), F.lit(shards - 1))
    return put.unionByName(_upto(rest, [], "bytes", BINS, "pool").select(*KEY, "rows", shard.alias("shard")))


def assigned(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, group: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key: one row a document."""
    base = stored(sized(docs, shards, group), "shards-docs")
    cells = base.groupBy(*KEY).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    cells = stored(cells.withColumn("linked", F.sum("rows").over(W.partitionBy("k1", "k2")) > 1), "shards-groups")
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = total / shards
    start = cells.where("linked").select(*KEY, "rows", "bytes", F.pmod("cell", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("moved"))
    linked, loads = settled(start, capacity, shards, rounds)
    pool = cells.where("not linked").select(*KEY, "rows", "bytes")
    kept = linked
    if max(loads) > capacity:
        out = stored(_overfull(linked, loads, capacity), "shards-out")
        kept = stored(linked.join(out.select(*KEY), list(KEY), "left_anti"), "shards-cells")
        loads, _ = _loads(kept, shards)
        pool = pool.unionByName(out)
    placed = kept.select(*KEY, "rows", "shard").unionByName(_filled(stored(pool, "shards-pool"), loads, capacity, shards))
    slots = _upto(stored(placed, "shards-placed"), ["shard"], "rows", BINS // 4, "slots").select(*[F.col(k).alias(f"_{k}") for k in KEY], "shard", "_before")
    at = F.lit(True)
    for k in KEY:
        at &= F.col(k) == F.col(f"_{k}")
    turn = F.row_number().over(W.partitionBy(*KEY).orderBy("doc_id", "size", "text_crc32")) - 1
    d = base.join(slots, at).withColumn("slot", (F.col("_before") + turn).cast("long"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("k1").alias("group_key"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rounds: int = ROUNDS) -> None:
    """Writes docs as Parquet, a folder a shard."""
    where = assigned(docs, shards, rounds).groupBy("doc_id", "group_key", "shard").agg(F.count("*").alias("rows"))
    name = next(n for n in (f"shard{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    held = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key"))
    met = held.join(where, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("group_key")))
    met.select("d.*", F.col("shard").alias(name)).write.partitionBy(name).option("compression", "zstd").parquet(path)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_shard_balance": op11}
ORACLES: dict = {}
