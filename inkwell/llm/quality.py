"""Operator 4: quality by a factorisation machine over hashed words, structure statistics and metadata.

Structure: shares of letters in upper case, digits, blanks, line breaks, sentence marks, other marks, bars and non-ASCII
bytes, word length, distinct share of words and of lines, logarithms of words and lines; metadata: n_chars (where the table has it). Each
is cut at fixed places into a bin, and bins are features of value 1, so that pairs of bins, or of a bin and a word, can
interact. Hashed words share a total weight of 1 (value 1/sqrt(distinct words)).

Defined cases: null or empty text has only its bins; a missing or null n_chars is a bin of its own; repeated rows each get a
row; labels of unknown documents are ignored; without labels all scores are 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import SPACE, slices, word_hashes, words
from inkwell.llm.factorisation import SAMPLE, Model, learn, score
from inkwell.llm.toxicity import BITS, THRESHOLD, distinct_terms, remainder
from inkwell.tables import table

SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 0.97])
LENGTHS = np.array([1, 2, 3, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15, 20, 30])
LOGS = np.arange(1.0, 18.0)
BINS = 20


def _one(of: str) -> np.ndarray:
    m = np.zeros(256)
    m[list(of.encode())] = 1
    return m


def _classes() -> np.ndarray:
    """256 x classes: which bytes count for which statistic."""
    letters = _one("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    high = np.zeros(256)
    high[128:] = 1
    ends = _one(".,;:?")
    upper, digit, blank, line, bar = _one("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _one("0123456789"), _one(" \t"), _one("\n"), _one("|")
    other = np.zeros(256)
    other[33:127] = 1
    other = np.clip(other - letters - digit - ends - bar, 0, 1)
    return np.stack([upper, digit, blank, line, ends, other, bar, high, letters], 1)


CLASSES = _classes()
STATISTICS = 14
NO_LINE = np.zeros(256, bool)
NO_LINE[10] = True


def _distinct_share(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each row, distinct share)."""
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return n, np.bincount(r[new], minlength=rows) / np.maximum(n, 1)


def structure(data: np.ndarray, at: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """rows x STATISTICS bins."""
    rows = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(rows), size)
    table_ = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256) @ CLASSES
    start, end, row = words(data, at)
    n, distinct = _distinct_share(row, word_hashes(data, start, end), rows)
    mean = np.bincount(row, end - start, rows) / np.maximum(n, 1)
    s2, e2, row2 = words(data, at, NO_LINE)
    lines, line_share = _distinct_share(row2, word_hashes(data, s2, e2), rows)
    shares = table_[:, :8] / np.maximum(size, 1)[:, None]
    shares[:, 0] = table_[:, 0] / np.maximum(table_[:, 8], 1)
    bins = [np.searchsorted(SHARES, shares[:, k], "right") for k in range(8)]
    bins += [np.searchsorted(LENGTHS, mean, "right"), np.searchsorted(SHARES, distinct, "right"), np.searchsorted(SHARES, line_share, "right")]
    bins += [np.searchsorted(LOGS, np.log2(1 + n), "right"), np.searchsorted(LOGS, np.log2(1 + lines), "right")]
    bins += [np.where(meta < 0, BINS - 1, np.searchsorted(LOGS, np.log2(2 + np.maximum(meta, 0)), "right"))]
    return np.stack(bins, 1)


def quality_features(texts: pa.Array, meta: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    known = np.full(len(texts), -1) if meta is None else np.nan_to_num(meta.to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
    for i, j, data, at in slices(texts):
        row, term = distinct_terms(data, at)
        n = np.bincount(row, minlength=j - i)
        bins = structure(data, at, known[i:j]) + np.arange(STATISTICS) * BINS + (1 << BITS)  # past all hashes
        all_rows = np.r_[row, np.repeat(np.arange(j - i), STATISTICS)]
        order = np.argsort(all_rows, kind="stable")
        value = np.r_[1 / np.sqrt(np.maximum(n[row], 1)), np.ones(bins.size)]
        yield i, j, all_rows[order], np.r_[term, bins.ravel()][order], value[order]


def _input(docs: DataFrame) -> DataFrame:
    meta = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", meta.alias("meta"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, label."""
    return learn(_input(docs), labels, quality_features, sample)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    return score(_input(docs), model, quality_features)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    out = quality(docs, train(docs, known))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4}
ORACLES: dict = {}
