"""Operator 5, quality classifier: importance resampling with hashed n-gram models.

Words and word pairs are hashed to BUCKETS; the target model counts them over all labelled good documents, the raw model
over all documents. A document's log weight is the log ratio of the two models, the sum over its n-grams, times an exponent (1: the
ratio itself); a Gumbel
number seeded by the row itself is added, and the k largest keys are kept, which samples k documents without replacement
in proportion to their weights. k is the share of good ones among the labelled, of all documents, if not given.

Defined cases: a null or empty text has no n-grams and the log weight of the worst document's side, minus infinity: it is kept only
if k asks for more documents than have n-grams; equal rows get equal keys and, where they meet at the k-th place, stand or
fall together; without labels of good documents the models are equal and the sample is uniform; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

BUCKETS, SMOOTHING, EXPONENT, SEED = 1 << 16, 1.0, 1.0, "resample-1"
BINS, FEW = 4096, 10_000
_WORD = re.compile(r"\w+|[^\w\s]+")
CACHE_ENTRIES = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def grams(text: str | None) -> np.ndarray:
    """The buckets of a text's words and word pairs. Runs of signs are words, capitals are kept apart."""
    if not text:
        return np.empty(0, dtype=np.int64)
    h = np.array([_hashes[w] for w in _WORD.findall(text)], dtype=np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([h % np.uint64(BUCKETS), (pairs >> np.uint64(40)) % np.uint64(BUCKETS)]).astype(np.int64)


def fit(docs: DataFrame) -> np.ndarray:
    """Log ratios by bucket from (text, is_target); a model of fixed size comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch["text"].array, batch["is_target"].array, strict=True):
                g = grams(text)
                np.add.at(raw, g, 1)
                if good:
                    np.add.at(target, g, 1)
        k = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": k, "raw": raw[k], "target": target[k]})

    counted = docs.select("text", "is_target").mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    target, raw = target + SMOOTHING, raw + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, by histograms of ever narrower ranges; ties count as often as they occur."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / BINS
        inside = keys.filter(F.col(key).between(low, high))
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        bins = {r.place: r for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for place in sorted(bins, reverse=True):
            if k <= bins[place].n:
                break
            k -= bins[place].n
        if (bins[place].low, bins[place].high) == (low, high):
            break
        low, high = bins[place].low, bins[place].high
        if bins[place].n <= FEW:
            own = sorted((r[0] for r in keys.filter(F.col(key).between(low, high)).select(key).collect()), reverse=True)
            return own[k - 1]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, share: float, seed: str = SEED, exponent: float = EXPONENT) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, kept) of all rows of docs (doc_id, text).

    target_ids: the ids of good documents; share: k as a share of all rows; exponent: below 1 it draws nearer to uniform.
    """
    good = target_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    marked = docs.select("doc_id", "text").join(broadcast_if_small(good), "doc_id", "left")
    ratios = docs.sparkSession.sparkContext.broadcast(fit(marked))

    def weigh(texts: pd.Series) -> pd.DataFrame:
        own = ratios.value
        found = [(len(g), float(own[g].sum()) * exponent if len(g) else -np.inf) for g in map(grams, texts)]
        return pd.DataFrame(found, columns=["n_grams", "log_weight"])

    row = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    u = (F.shiftrightunsigned(F.xxhash64(row), 11).cast("double") + 0.5) / float(2**53)
    scored = docs.select("doc_id", F.pandas_udf(weigh, "n_grams long, log_weight double")("text").alias("w"), (-F.log(-F.log(u))).alias("gumbel"))
    # a weight of nothing is a finite number here, below all others
    key = F.when(F.col("w.n_grams") > 0, F.col("w.log_weight") + F.col("gumbel")).otherwise(F.lit(-1e6) + F.col("gumbel"))
    scored = materialize(scored.select("doc_id", "w.n_grams", "w.log_weight", key.alias("sample_key")), "resample-keys")
    k = round(share * scored.count())
    at = largest(scored, "sample_key", k) if k else np.inf
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(float(at)))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), labels.filter("quality = 1"), share)
