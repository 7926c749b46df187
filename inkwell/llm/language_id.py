"""Operator 7: language of web pages by Bayesian evidence fusion.

    log P(l | page) = log P(l | host) + log P(text | l) / temper + log P(declared | l) + log P(suffix | l) + const

* text: byte trigrams, hashed to 2^16 places, under a multinomial for each language learnt from labelled documents; long
  texts' likelihoods are tempered (trigrams of one text are not independent).
* votes: the language that text alone gives each page. Grouped counts of votes, over all pages, give the rest:
* declared: P(declared markup language | l), add-one smoothed, so wrong declarations weigh as little as they deserve;
* suffix: P(last label of the host name | l), add-one smoothed;
* host: the host's votes without the page's own, smoothed by its site's (last two labels) share of votes, which is smoothed
  by all pages' share: (n + a P(l | level above)) / (N + a).

All counts are partially aggregated; host rows are unique, so a hot host is one row of counts. What is broadcast is the
trigram table: languages x 65,536 numbers.

Defined cases: null html has no text and no declaration (evidence left out); null url has no host and no suffix (the prior
is all pages' share); repeated rows each vote; ties go to the first language by name; documents without language teach
nothing; without labelled documents lang is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.byte_arrays import LOWER, slices
from inkwell.tables import stored, table

PLACES = 1 << 16
TEMPER = 4.0
STRENGTH = 8.0
MIX = np.uint64(0x9E3779B97F4A7C15)

HIDDEN = r"(?is)<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each byte trigram inside a row; blanks and digits count as one blank."""
    low = LOWER[data].astype(np.uint64)
    low[(low < 65)] = 32
    g = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:] if len(low) > 2 else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        place = ((g * MIX) >> np.uint64(48)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = row[:-2] == row[2:] if len(row) > 2 else np.zeros(0, bool)
    return row[:-2][same] if len(row) > 2 else np.zeros(0, np.int64), place[same]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages by name, their log probabilities of trigrams: languages x PLACES) from all of docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for i, j, data, at in slices(b.column(0)):
                row, place = trigrams(data, at)
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                both = np.bincount(code[row] * PLACES + place, minlength=len(names) * PLACES).reshape(len(names), PLACES)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + both[k]
        for name, n in total.items():
            where = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(where)), pa.array(where.astype(np.int32)), pa.array(n[where])], names=["lang", "place", "n"])

    counts = docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # languages x 65,536 rows at most
    langs, code = np.unique(np.array(got["lang"].to_pylist(), object).astype(str), return_inverse=True)
    n = np.zeros((len(langs), PLACES))
    n[code, got["place"].to_numpy()] = got["n"].to_numpy()
    return [str(x) for x in langs], np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * PLACES))


def likelihoods(pages: DataFrame, model: tuple[list[str], np.ndarray], temper: float = TEMPER) -> DataFrame:
    """page_id, host, declared, bytes, fit array<double> (tempered log likelihood for each language)."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log = held.value
        for b in batches:
            for i, j, data, at in slices(b.column(3)):
                row, place = trigrams(data, at)
                n = np.bincount(row, minlength=j - i)
                fit = np.stack([np.bincount(row, log[k][place], j - i) for k in range(len(langs))], 1) if langs else np.zeros((j - i, 0))
                # the first 20 trigrams' worth counts in full, what follows by 1/temper
                weight = (np.minimum(n, 20) + np.maximum(n - 20, 0) / temper) / np.maximum(n, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(langs), pa.int32()), pa.array((fit * weight[:, None]).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(3)), pa.array(n), lists], names=["page_id", "host", "declared", "trigrams", "fit"])

    text = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    p = pages.select("page_id", host(F.col("url")).alias("host"), declared(F.col("html")).alias("declared"), text.alias("text"))
    return p.mapInArrow(run, "page_id long, host string, declared string, trigrams long, fit array<double>")


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def declared(html: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def identify(pages: DataFrame, docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared for pages(page_id, url, html), learnt from docs(text, lang)."""
    langs, log = learn(docs)
    p = likelihoods(pages, (langs, log))
    if not langs:
        return p.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared")
    names = F.array(*[F.lit(x) for x in langs])
    p = p.withColumn("vote", F.when(F.col("trigrams") > 0, F.array_position("fit", F.array_max("fit")).cast("int")))
    parts = F.split("host", r"\.")
    p = p.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1))).withColumn("site", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")))
    p = stored(p, "language")
    of = F.array(*[F.count_if(F.col("vote") == k + 1) for k in range(len(langs))])
    all_ = p.agg(of.alias("n_all"))
    tables = {k: stored(p.where(F.col(k).isNotNull()).groupBy(k).agg(of.alias(f"n_{k}")), f"language-{k}") for k in ("host", "site", "declared", "suffix")}
    kinds = {k: tables[k].count() for k in ("declared", "suffix")}
    p = p.withColumn("n_all", F.array(*[F.lit(x) for x in all_.first()["n_all"]]))  # one row
    for key, t in tables.items():
        p = p.join(t, key, "left")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    none = F.array_repeat(F.lit(0).cast("long"), len(langs))
    own = F.transform(F.sequence(F.lit(1), F.lit(len(langs))), lambda k: F.when(k == F.col("vote"), F.lit(1)).otherwise(F.lit(0)))
    rest = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.zip_with(c, own, lambda a, o: a - o))
    p = p.withColumn("n_host", rest("n_host")).withColumn("n_site", rest("n_site"))
    top = F.transform("n_all", lambda a: (a + 1) / (total(F.col("n_all")) + len(langs)))
    smooth = lambda counts, above: F.zip_with(counts, above, lambda a, q: (a + strength * q) / (total(F.col(counts)) + strength))
    p = p.withColumn("p_all", top).withColumn("p_site", smooth("n_site", F.col("p_all"))).withColumn("p_host", smooth("n_host", F.col("p_site")))
    given = lambda key: F.when(F.col(key).isNull(), F.array_repeat(F.lit(0.0), len(langs))).otherwise(F.zip_with(f"n_{key}", "n_all", lambda a, n: F.log((a + 1) / (n + kinds[key]))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    p = p.withColumn("score", add(add(add(F.transform("p_host", lambda x: F.log(x)), F.col("fit")), given("declared")), given("suffix")))
    p = p.withColumn("best", F.array_max("score"))
    odds = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    return p.select("page_id", F.element_at(names, F.array_position("score", F.col("best")).cast("int")).alias("lang"), (1 / odds).alias("confidence"), F.try_element_at(names, F.col("vote")).alias("text_lang"), "declared")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op7_language_id": op7}
ORACLES: dict = {}
