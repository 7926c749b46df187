"""Operator 6: toxicity by a factorisation machine over hashed terms.

A document's features are its distinct terms (runs of letters, digits and non-ASCII bytes, A-Z lowered) and the stems of longer
terms (their first bytes, so that inflected forms meet), hashed, all with value 1. The machine learns single terms and pairs of
them (an insult beside a group's name), which no additive weight can tell: features are kept that tell something alone or in a
pair. Only texts and labels of training rows are used.

Defined cases: null or empty text has no terms and scores the bias; a null doc_id is kept and is never held out by its
remainder (crc32 of the empty text); repeated rows each get a row; labels of unknown documents are ignored; without labels
all scores are 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import LOWER, NO_TERM, mixed, slices, word_hashes, words
from inkwell.llm.factorisation import SAMPLE, Model, learn, score
from inkwell.tables import table

BITS = 44
MASK = (1 << BITS) - 1
#: Stems are the first so many bytes of longer terms.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
SCREEN = 3.0
#: Pairs are tested among so many of the sample's commonest features.
PAIRED = 1024
RATE = 0.3


def distinct_terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 44-bit hash) of each distinct term of each row, sorted."""
    start, end, row = words(data, at, NO_TERM)
    both = np.unique((row << BITS) | _short(word_hashes(LOWER[data], start, end)))
    return both >> BITS, both & MASK


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def term_features(texts: pa.Array, meta: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, at in slices(texts):
        low = LOWER[data]
        start, end, row = words(low, at, NO_TERM)
        found, where = np.unique((row << BITS) | _short(word_hashes(low, start, end)), return_index=True)
        start, end, row = start[where], end[where], row[where]
        all_ = [found]
        for n in STEMS:
            long = end - start > n
            s = start[long]
            salted = mixed(word_hashes(low, s, s + n) + np.uint64(n))
            all_.append(np.unique((row[long] << BITS) | _short(salted)))
        all_ = np.sort(np.concatenate(all_))
        yield i, j, all_ >> BITS, all_ & MASK, np.ones(len(all_))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, label."""
    return learn(docs.select("doc_id", "text", F.lit(None).cast("long").alias("meta")), labels, term_features, sample, screen=SCREEN, rate=RATE, pairs=PAIRED)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("meta")), model, term_features)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores under the threshold; all columns as given, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, row, feature, value in term_features(b.column(at), None):
                keep[i:j] = m.score(j - i, row, feature, value) < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity(docs, train(docs, known))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6}
ORACLES: dict = {}
