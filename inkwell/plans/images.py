"""Queries on image hashes. Hashes of documents are their first 16 hex digits of an md5, with some bits flipped for copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import pictures as I
from inkwell.tables import table


def _grids(spark, sf_dir):
    """The first 72 numbers made from each embedding, as brightness (0 to 255)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000 % 256).cast("double")).alias("v"))
    return e.select("vec_id", F.concat("v", F.slice("v", 1, 8)).alias("grid"))


GRIDS = "g AS (SELECT vec_id, list_transform(embedding, lambda x: floor((abs(x::DOUBLE) * 1000) % 256)) AS v FROM embeddings), gr AS (SELECT vec_id, v || v[1:8] AS grid FROM g)"


def m07(spark, sf_dir):
    return _grids(spark, sf_dir).select("vec_id", I.difference_hash(F.col("grid")).alias("hash"), I.is_trivial(F.col("grid"), F.lit(64), F.lit(64)).alias("trivial"))


M07 = f"""WITH {GRIDS}, b AS (SELECT vec_id, grid, list_transform(range(64), lambda i: CASE WHEN grid[(i // 8) * 9 + i % 8 + 1] > grid[(i // 8) * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS bits, list_avg(grid) AS m FROM gr)
SELECT vec_id, array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', (bits[4 * k + 1] * 8 + bits[4 * k + 2] * 4 + bits[4 * k + 3] * 2 + bits[4 * k + 4] + 1)::INT, 1)), '') AS hash, sqrt(list_sum(list_transform(grid, lambda x: (x - m) * (x - m))) / 72) < 6 AS trivial FROM b"""


def _hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring(F.md5((F.col("doc_id") - F.col("doc_id") % 3).cast("string").cast("binary")), 1, 14).alias("h"), (F.col("doc_id") % 3).alias("k"))
    tail = F.element_at(F.array(F.lit("00"), F.lit("1f"), F.lit("ff")), (F.col("k") + 1).cast("int"))
    d = d.withColumn("hash", F.concat("h", tail))
    return d.select("id", "hash", F.array(F.struct(F.lit("flipped").alias("transform"), F.reverse("hash").alias("hash"))).alias("variants"))


HASHES = "h AS (SELECT doc_id AS id, substr(md5((doc_id - doc_id % 3)::VARCHAR), 1, 14) || ['00', '1f', 'ff'][(doc_id % 3 + 1)::INT] AS hash, doc_id - doc_id % 3 AS g FROM documents)"


def m06(spark, sf_dir):
    d = _hashes(spark, sf_dir).select("id", "hash")
    n = d.select((F.col("id") - 1).alias("id"), F.col("hash").alias("next"))
    return d.join(n, "id").select("id", I.hamming(F.col("hash"), F.col("next")).alias("distance"))


BITS = "bit_count(xor(('0x' || substr({a}, 1, 8))::BIGINT, ('0x' || substr({b}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({a}, 9, 8))::BIGINT, ('0x' || substr({b}, 9, 8))::BIGINT))"


def j19(spark, sf_dir):
    return I.near_pairs(_hashes(spark, sf_dir))


J19 = f"""WITH {HASHES}, p AS (SELECT x.id AS a, y.id AS b, least({BITS.format(a='x.hash', b='y.hash')}, {BITS.format(a='x.hash', b='reverse(y.hash)')}) AS d, {BITS.format(a='x.hash', b='y.hash')} AS s FROM h x JOIN h y ON x.id < y.id) SELECT a, b, CASE WHEN d = s THEN 'same' ELSE 'flipped' END AS transform, d AS distance FROM p WHERE d <= 8"""


def j20(spark, sf_dir):
    d = _hashes(spark, sf_dir)
    return I.first_figures(I.near_pairs(d.where("id % 3 = 0"), d.where("id % 3 != 0")))


J20 = f"""WITH {HASHES}, p AS (SELECT x.id AS a, y.id AS b, least({BITS.format(a='x.hash', b='y.hash')}, {BITS.format(a='x.hash', b='reverse(y.hash)')}) AS d, {BITS.format(a='x.hash', b='y.hash')} AS s FROM h x JOIN h y ON x.id % 3 = 0 AND y.id % 3 != 0)
SELECT a, b, CASE WHEN d = s THEN 'same' ELSE 'flipped' END AS transform, d AS distance FROM p WHERE d <= 8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1"""

QUERIES = {"m07_difference_hash": m07, "m06_hamming": m06, "j19_near_images": j19, "j20_figure_matches": j20}
ORACLES = {"m07_difference_hash": M07, "m06_hamming": f"WITH {HASHES} SELECT x.id, {BITS.format(a='x.hash', b='y.hash')} AS distance FROM h x JOIN h y ON y.id = x.id + 1", "j19_near_images": J19, "j20_figure_matches": J20}
