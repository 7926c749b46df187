"""Second-order factorisation machines over sparse rows: fitting on a bounded labelled sample and scoring whole tables.

    logit = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

the pair term in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Features are 44-bit hashes; the
model keeps those that the bounded sample made useful, so its size, and what is broadcast, is bounded by the sample whatever
the data. Fitting takes at most `sample` labelled documents, those
with the least hash of their id; scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.tables import discard, stored

#: (texts, metadata) of a batch -> parts of (first row, last row + 1, row, feature, value), rows ascending.
Features = Callable[[pa.Array, "pa.Array | None"], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]

SAMPLE = 10_000


@dataclass
class Model:
    bias: float
    ids: np.ndarray  # sorted features
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.likely = np.zeros(1 << 20, bool)  # by a feature's last 20 bits: most features of a text are not in the model
        self.likely[self.ids & 0xFFFFF] = True

    def score(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each of `rows` rows; a row without known features gets the bias."""
        logit = np.full(rows, self.bias)
        maybe = np.flatnonzero(self.likely[feature & 0xFFFFF])
        place = np.searchsorted(self.ids, feature[maybe])
        place[place == len(self.ids)] = 0
        hit = self.ids[place] == feature[maybe] if len(self.ids) else np.zeros(len(maybe), bool)
        place, row, value = place[hit], row[maybe[hit]], value[maybe[hit]]
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            xv = self.factors[place] * value[:, None]
            pairs = (np.add.reduceat(xv, first, axis=0, dtype=np.float64) ** 2).sum(1) - np.add.reduceat((xv * xv).sum(1), first, dtype=np.float64)
            logit[row[first]] += np.add.reduceat(self.linear[place] * value, first, dtype=np.float64) + pairs / 2
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, factors: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 2e-4, least: int = 4, screen: float = 0.0, pairs: int = 0, places: int | None = None, seed: int = 7) -> Model:
    """Logistic loss, both classes of equal weight up to a factor of 3, adaptive steps; features in fewer than `least` rows keep weight 0.

    screen: so many standard deviations must a feature's count among rows of label 1 be off its expectation; it keeps rare
    chance words out where labels are few. Of the `pairs` features that most rows have, those of a pair that tells more than both
    of its features do are kept too (`interacting`), however little each tells alone."""
    random = np.random.default_rng(seed)
    ids, feature = np.unique(feature, return_inverse=True) if places is None else (np.arange(places), feature)
    size = len(ids)
    count = np.bincount(feature, minlength=size)
    useful = count >= least
    if screen and rows:
        mean = label.mean()
        expected = count * mean
        spread = np.sqrt(expected * (1 - mean) * np.maximum(1 - count / rows, 1e-9)) + 1e-9
        told = np.abs(np.bincount(feature, label[row], size) - expected) >= screen * spread
        if pairs:
            told |= interacting(rows, row, feature, count, label, pairs)
        useful &= told
    used = np.flatnonzero(useful)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[feature] >= 0
    row, at, value = row[keep], place[feature[keep]], value[keep].astype(np.float64)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    n = len(used)
    w, v = np.zeros(n), random.normal(0, 0.02, (n, factors))
    rate_label = float(np.clip(label.mean() if rows else 0.5, 0.02, 0.98))
    bias = np.log(rate_label / (1 - rate_label))
    weight = np.where(label > 0, min(3.0, max(1.0, (1 - rate_label) / rate_label)), min(3.0, max(1.0, rate_label / (1 - rate_label))))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(rows)
        for i in range(0, rows, batch):
            docs = order[i : i + batch]
            lengths = bounds[docs + 1] - bounds[docs]
            where = np.repeat(bounds[docs] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            seg = np.repeat(np.arange(len(docs)), lengths)
            f, x = at[where], value[where]
            at_, f = np.unique(f, return_inverse=True)
            xv = v[at_][f] * x[:, None]
            total = np.stack([np.bincount(seg, xv[:, k], len(docs)) for k in range(factors)], 1)
            logit = bias + np.bincount(seg, w[at_][f] * x, len(docs)) + ((total**2).sum(1) - np.bincount(seg, (xv * xv).sum(1), len(docs))) / 2
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[docs]) * weight[docs] / len(docs)
            ex = error[seg] * x
            dw = np.bincount(f, ex, len(at_)) + decay * w[at_]
            inner = ex[:, None] * (total[seg] - xv)
            dv = np.stack([np.bincount(f, inner[:, k], len(at_)) for k in range(factors)], 1) + decay * v[at_]
            gw[at_] += dw * dw
            gv[at_] += dv * dv
            w[at_] -= rate * dw / np.sqrt(gw[at_])
            v[at_] -= 0.3 * rate * dv / np.sqrt(gv[at_])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
    return Model(float(bias), ids[used], w.astype(np.float32), v.astype(np.float32))


def interacting(rows: int, row: np.ndarray, feature: np.ndarray, count: np.ndarray, label: np.ndarray, most: int, off: float = 6.0, together: int = 10) -> np.ndarray:
    """For each feature, whether it is in a pair whose share of label 1 is `off` standard deviations from what additive weights of
    the two give, among pairs that `together` rows or more have of the `most` commonest features (most x most numbers at once)."""
    out = np.zeros(len(count), bool)
    top = np.sort(np.argsort(-count, kind="stable")[:most])
    place = np.full(len(count), -1)
    place[top] = np.arange(len(top))
    keep = place[feature] >= 0
    r, f = row[keep], place[feature[keep]]
    both, ones = (np.zeros((len(top), len(top)), np.float32) for _ in range(2))
    for i in range(0, rows, 1_000):  # rows ascend
        a, b = np.searchsorted(r, [i, i + 1_000])
        x = np.zeros((min(1_000, rows - i), len(top)), np.float32)
        x[r[a:b] - i, f[a:b]] = 1
        both += x.T @ x
        x = x[label[i : i + 1_000] > 0]
        ones += x.T @ x
    logit = lambda p: np.log(p / (1 - p))
    mean = min(max(label.mean(), 0.5 / rows), 1 - 0.5 / rows)
    alone = logit((np.diag(ones) + mean) / (np.diag(both) + 1))
    expected = 1 / (1 + np.exp(-np.clip(alone[:, None] + alone[None, :] - logit(mean), -30, 30)))
    spread = np.sqrt(both * expected * (1 - expected) + 0.5)
    far = (np.abs(ones - both * expected) >= off * spread) & (both >= together)
    np.fill_diagonal(far, False)
    out[top] = far.any(1)
    return out


def learn(docs: DataFrame, labels: DataFrame, features: Features, sample: int = SAMPLE, least: int = 4, **how) -> Model:
    """Fits on at most `sample` of labels(doc_id, label). A repeated doc_id in labels counts once, with its highest label.

    Features of fewer than `least` rows of the sample, which most are, are left in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, feature, value in features(b.column("text"), b.column("meta")):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (feature, value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("label")[i:j], *lists], names=["doc_id", "label", "feature", "value"])

    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample).drop("_h")
    known = docs.select("doc_id", "text", "meta").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    rows_ = stored(known.select("doc_id", "label", "text", "meta").mapInArrow(run, "doc_id long, label int, feature array<bigint>, value array<float>"), "sample")
    ids = rows_.select(F.explode("feature").alias("f")).groupBy("f").count().where(F.col("count") >= least).select("f").toArrow()["f"].to_numpy()
    held = spark.sparkContext.broadcast(np.sort(ids))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            one = not bool(np.any(b.column(3).flatten().to_numpy() != 1))
            feature, n = b.column(2).flatten().to_numpy(), np.diff(b.column(2).offsets.to_numpy())
            place = np.searchsorted(known, feature)
            place[place == len(known)] = 0
            keep = known[place] == feature if len(known) else np.zeros(len(feature), bool)
            row = np.repeat(np.arange(b.num_rows), n)[keep]
            cut = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            places = pa.ListArray.from_arrays(cut, pa.array(place[keep].astype(np.int32)))
            values = pa.nulls(b.num_rows, pa.list_(pa.float32())) if one else pa.ListArray.from_arrays(cut, pa.array(b.column(3).flatten().to_numpy()[keep]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), places, values], names=["doc_id", "label", "place", "value"])  # no values: all are 1

    got = rows_.mapInArrow(coded, "doc_id long, label int, place array<int>, value array<float>").sort("doc_id").toArrow().combine_chunks()
    discard(rows_)
    held.unpersist()
    flat = lambda name: got[name].chunk(0) if isinstance(got[name], pa.ChunkedArray) and got[name].num_chunks else got[name]
    if not got.num_rows:
        return Model(0.0, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    rows, label = got.num_rows, got["label"].to_numpy().astype(np.float64)
    places = flat("place")
    row, feature = np.repeat(np.arange(rows, dtype=np.int32), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()
    none = got["value"].null_count
    value = np.ones(1, np.float32) if none == rows else flat("value").flatten().to_numpy() if not none else None
    if value is None:  # a batch without values has only ones
        held_values = got["value"].to_pylist()
        value = np.concatenate([np.ones(n, np.float32) if v is None else np.array(v, np.float32) for v, n in zip(held_values, np.diff(places.offsets.to_numpy()).tolist(), strict=True)])
        del held_values
    elif none:
        value = np.broadcast_to(value, len(feature))
    known = np.sort(ids)
    model = fit(rows, row, feature, value, label, least=least, places=len(known), **how)
    model = Model(model.bias, known[model.ids], model.linear, model.factors) if len(known) else model
    del got, places, row, feature, value
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, features: Features) -> DataFrame:
    """docs(doc_id, text, meta) -> doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for i, j, row, feature, value in features(b.column("text"), b.column("meta")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(m.score(j - i, row, feature, value))], names=["doc_id", "score"])

    return docs.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, score double")
