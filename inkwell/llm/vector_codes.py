"""Operator 12: vectors as codes of parts, codebooks by Lloyd's algorithm with heaps of bounds (Heap Lloyd).

Each component x becomes the integer floor(4096 x); vectors are cut into equal consecutive parts, and each part position has
a codebook of its own, which starts as that part of the rows with the smallest vec_ids. A round assigns every part to its
nearest entry (squared Euclidean distance in integers, ties to the lower index) and replaces entries by floored means.

Rows live in blocks, one row of a stored table each, with a heap for every (part position, entry). A part's key in its
entry's heap is its slack: distance to the second nearest entry minus distance to its own, plus the entry's drift so far.
When entries move, an entry's drift grows by its own step and the longest step of any other. While slack exceeds what was
added since, the nearest entry can't have changed; so a round pops only the parts whose key the drift has reached, scans
them against all entries exactly and pushes them again. Keys are doubles, compared with a margin far above their rounding;
what ties or comes near is scanned, so assignments are those of the plain algorithm.

Between rounds only changes of sums and counts by (position, entry) leave the tasks: parts x entries x (width + 1) numbers,
added up by Spark before the driver sees them. Blocks go from round to round through a stored table, so a lost executor
costs its tasks only.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors of
another length than the first kept one's (by vec_id) or than a multiple of the number of parts; a null vec_id comes last;
rows of equal vec_id go by their components; with fewer rows than entries, a codebook has as many entries as rows; integers
are held within 2^27 of zero (components within 32768); repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.tables import discard, stored, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096
SCAN = 1 << 14
EDGE = 1 << 27
#: Labels with more than one row in so many are joined by broadcast; there are fewer of them than this number.
HOT = 1000


def integers(components: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(components.astype(np.float64) * SCALE), -EDGE, EDGE).astype(np.int64)


class Block:
    """Part vectors of some rows, their entries and the heaps of their slack."""

    def __init__(self, parts: np.ndarray, entries: int):
        self.parts = parts  # rows x positions x width
        self.code = np.zeros(parts.shape[:2], np.uint8)
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(parts.shape[1])]

    def packed(self) -> tuple:
        flat = [h for part in self.heaps for h in part]
        small = np.abs(self.parts).max(initial=0) < 1 << 15
        pairs = [x for h in flat for x in h]
        return (
            self.parts.astype(np.int16 if small else np.int32).tobytes(), bool(small), self.code.tobytes(), np.array([len(h) for h in flat], np.int32).tobytes(),
            np.array([k for k, _ in pairs], np.float64).tobytes(), np.array([i for _, i in pairs], np.int32).tobytes(),
        )

    @classmethod
    def unpacked(cls, row: dict, positions: int, entries: int, width: int) -> Block:
        parts = np.frombuffer(row["parts"], np.int16 if row["small"] else np.int32).astype(np.int64).reshape(-1, positions, width)
        out = cls(parts, entries)
        out.code = np.frombuffer(row["code"], np.uint8).reshape(-1, positions).copy()
        keys, rows, at = np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["rows"], np.int32).tolist(), 0
        for k, n in enumerate(np.frombuffer(row["sizes"], np.int32).tolist()):
            out.heaps[k // entries][k % entries] = list(zip(keys[at : at + n], rows[at : at + n], strict=True))  # stored in heap order
            at += n
        return out

    def settle(self, books: np.ndarray, drift: np.ndarray, fresh: bool) -> tuple[np.ndarray, int]:
        """Brings entries up to date; returns changes of sums and counts (positions x entries x (width + 1)) and parts scanned."""
        positions, entries, width = books.shape
        change = np.zeros((positions, entries, width + 1), np.int64)
        scanned = 0
        for p in range(positions):
            heaps, due = self.heaps[p], []
            if fresh:
                due = list(range(len(self.parts)))
            else:
                for e, heap in enumerate(heaps):
                    bound = drift[p, e] + 1e-6 + 1e-9 * drift[p, e]
                    while heap and heap[0][0] <= bound:
                        due.append(heapq.heappop(heap)[1])
            scanned += len(due)
            for at in range(0, len(due), SCAN):
                rows = np.array(due[at : at + SCAN])
                x = self.parts[rows, p]
                far = ((x[:, None, :] - books[p][None]) ** 2).sum(-1)
                now, was = far.argmin(1), self.code[rows, p]
                own = far[np.arange(len(rows)), now]
                second = np.partition(far, 1, axis=1)[:, 1] if entries > 1 else np.full(len(rows), np.inf)
                keys = np.sqrt(second.astype(np.float64)) - np.sqrt(own.astype(np.float64)) + drift[p, now]
                moved = np.ones(len(rows), bool) if fresh else now != was
                np.add.at(change[p, :, :width], now[moved], x[moved])
                np.add.at(change[p, :, width], now[moved], 1)
                if not fresh:
                    np.subtract.at(change[p, :, :width], was[moved], x[moved])
                    np.subtract.at(change[p, :, width], was[moved], 1)
                self.code[rows, p] = now
                for e, pair in zip(now.tolist(), zip(keys.tolist(), rows.tolist(), strict=True), strict=True):
                    heaps[e].append(pair) if fresh else heapq.heappush(heaps[e], pair)
            if fresh:
                for heap in heaps:
                    heapq.heapify(heap)
        return change, scanned


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries replaced by floored means of their parts; unused ones stay."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), books)


def added_drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much less apart a part's own and any other entry may be: the own entry's step and the longest of the others."""
    step = np.sqrt(((new - old) ** 2).sum(-1).astype(np.float64))
    if step.shape[1] < 2:
        return step
    order = np.sort(step, axis=1)
    longest, next_longest = order[:, -1:], order[:, -2:-1]
    return step + np.where(step == longest, next_longest, longest) if (order[:, -1] > order[:, -2]).all() else step + longest


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector is whole and finite."""
    x = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.where((F.size("embedding") > 0) & whole)


STATE = "vec_ids array<{id}>, labels array<{label}>, parts binary, small boolean, code binary, sizes binary, keys binary, rows binary, change array<long>, scanned long"


def _lists(column: pa.Array, at: int, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column.slice(at, n))


def _row(vec_ids: pa.Array, labels: pa.Array, block: Block, change: np.ndarray, scanned: int) -> pa.RecordBatch:
    packed = [pa.array([x]) for x in block.packed()]
    names = ["vec_ids", "labels", "parts", "small", "code", "sizes", "keys", "rows", "change", "scanned"]
    return pa.RecordBatch.from_arrays([vec_ids, labels, *packed, pa.array([change.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())], names=names)


def _first(kept: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                n = min(BLOCK, b.num_rows - at)
                x = b.column(2).slice(at, n).flatten().to_numpy(zero_copy_only=False)
                block = Block(integers(x).reshape(n, positions, width), entries)
                change, scanned = block.settle(books, np.zeros((positions, entries)), True)
                yield _row(_lists(b.column(0), at, n), _lists(b.column(1), at, n), block, change, scanned)

    return kept.mapInArrow(run, schema)


def _next(state: DataFrame, books: np.ndarray, drift: np.ndarray, schema: str) -> DataFrame:
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {k: b.column(k)[r].as_py() for k in ("parts", "small", "code", "sizes", "keys", "rows")}
                block = Block.unpacked(row, positions, entries, width)
                yield _row(b.column("vec_ids").slice(r, 1), b.column("labels").slice(r, 1), block, *block.settle(books, drift, False))

    return state.mapInArrow(run, schema)


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums over all blocks: positions x entries x (width + 1) numbers."""
    rows = state.select(F.posexplode("change")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows:
        out[r.pos] = r.n
    return out.reshape(shape)


def trained(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(stored blocks with final codes, final codebooks positions x entries x width, parts scanned in each assignment)."""
    firsts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    books = np.stack([integers(np.array(r.embedding)).reshape(parts, width // parts) for r in firsts], 1)
    schema = STATE.format(id=kept.schema["vec_id"].dataType.simpleString(), label=kept.schema["label"].dataType.simpleString())
    shape = (*books.shape[:2], books.shape[2] + 1)
    state, drift, sums, scanned = stored(_first(kept, books, schema), "codes"), np.zeros(books.shape[:2]), np.zeros(shape, np.int64), []
    for _ in range(rounds):
        sums = sums + _changes(state, shape)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        new = moved_books(books, sums)
        drift, books = drift + added_drift(books, new), new
        later = stored(_next(state, books, drift, schema), "codes")
        discard(state)
        state = later
    return state, books, [*scanned, state.agg(F.sum("scanned")).first()[0]]


def encoded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index of two hex digits a part), error (squared distance of the decoded vector)."""
    positions, entries, width = books.shape
    kinds = state.schema["vec_ids"].dataType.elementType.simpleString(), state.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = np.frombuffer(b.column("parts")[r].as_py(), np.int16 if b.column("small")[r].as_py() else np.int32).astype(np.int64).reshape(-1, positions, width)
                held = b.column("code")[r].as_py()
                code = np.frombuffer(held, np.uint8).reshape(-1, positions)
                error = ((x - books[np.arange(positions), code]) ** 2).sum((1, 2))
                hexed = [held[i : i + positions].hex() for i in range(0, len(held), positions)]
                yield pa.RecordBatch.from_arrays([b.column("vec_ids").slice(r, 1).flatten(), b.column("labels").slice(r, 1).flatten(), pa.array(hexed, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.select("vec_ids", "labels", "parts", "small", "code").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def with_label_sums(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over the rows of a label. Labels with more than a thousandth of all rows, fewer than a
    thousand of them, meet their rows by broadcast, the others by a shuffle."""
    sums = stored(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-sums")
    least = (sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] or 0) / HOT
    same = F.col("label").eqNullSafe(F.col("_label"))
    with_hot = rows.join(F.broadcast(sums.where(F.col("_n") > least)), same, "left")
    names = [*rows.columns, "label_error"]
    met = with_hot.where(F.col("_n").isNotNull()).select(*names)
    rest = with_hot.where(F.col("_n").isNull()).select(*rows.columns).join(sums.where(F.col("_n") <= least), same)
    return met.unionByName(rest.select(*names))


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label: one row a kept vector."""
    kept = usable(vectors)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).limit(1).collect()
    width = first[0][0] if first else 0
    if not width or width % parts:
        kind = T.StructType([kept.schema["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType()), kept.schema["label"]])
        return vectors.sparkSession.createDataFrame([], kind)
    state, books, _ = trained(kept.where(F.size("embedding") == width), width, parts, entries, rounds)
    rows = stored(encoded(state, books), "codes-rows")
    discard(state)
    told = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    return with_label_sums(rows).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"), "label")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The plain algorithm, round by round."""
    part = [r"""kept AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "part AS MATERIALIZED (SELECT rid, vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range(8) AS t(p))",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e, x FROM part QUALIFY e < 16)"]
    far = "list_sum(list_transform(range(1, 9), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))::BIGINT"
    for r in range(ROUNDS + 1):
        part.append(f"near{r} AS MATERIALIZED (SELECT rid, a.p, any_value(a.x) AS x, min({{'far': {far}, 'e': b.e}}) AS best FROM part a JOIN book{r} b ON a.p = b.p GROUP BY rid, a.p)")
        if r < ROUNDS:
            means = ", ".join(f"(sum(x[{i}])::BIGINT - ((sum(x[{i}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, 9))
            part.append(f"mean{r} AS (SELECT p, best.e AS e, [{means}] AS x FROM near{r} GROUP BY p, best.e)")
            part.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    return f"""WITH {", ".join(part)},
coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid),
told AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM kept JOIN coded USING (rid), told"""


QUERIES = {"op12_vector_codes": op12}
ORACLES = {"op12_vector_codes": _sql()}
