"""Library profiling: fragment-length histograms, medians, trimmed cutoffs and qualities per read group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import round_half_up

CUTOFF, TRIM = 0.01, 0.002


def histogram(pairs: DataFrame) -> DataFrame:
    """(read_group, frag_len, freq); lengths of 0 or less are invalid and not counted."""
    return pairs.filter("frag_len > 0").groupBy("read_group", "frag_len").agg(F.count("*").alias("freq"))


def cumulative(hist: DataFrame) -> DataFrame:
    """The histogram with sums from both ends and the total. Windows run over bins, not over pairs."""
    up = Window.partitionBy("read_group").orderBy("frag_len").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("read_group").orderBy(F.desc("frag_len")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumns({"cum_asc": F.sum("freq").over(up), "cum_desc": F.sum("freq").over(down), "total": F.sum("freq").over(Window.partitionBy("read_group"))})


def statistics(hist: DataFrame) -> DataFrame:
    """Mean, median (the first bin at half of all), and sample deviation per read group."""
    c = cumulative(hist)
    x, w = F.col("frag_len").cast("double"), F.col("freq")
    sums = c.groupBy("read_group").agg(
        F.sum("freq").alias("n_pairs"), F.sum(x * w).alias("s1"), F.sum(x * x * w).alias("s2"), F.min(F.when(2 * F.col("cum_asc") >= F.col("total"), F.col("frag_len"))).alias("median")
    )
    n = F.col("n_pairs").cast("double")
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)
    return sums.select("read_group", "n_pairs", (F.col("s1") / n).alias("mean"), "median", F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0).alias("stdev"))


def cutoffs(hist: DataFrame, cutoff: float = CUTOFF, trim: float = TRIM, min_pairs: int = 0, min_bins: int = 0) -> DataFrame:
    """Two-sided trimmed cutoffs; libraries with too few pairs or bins keep their row with nulls."""
    share = lambda side: (F.col(side) - trim / 2 * F.col("total")) / (F.col("total") * (1 - trim)) > cutoff / 2
    c = cumulative(hist).groupBy("read_group").agg(
        F.max("total").alias("n_pairs"), F.count("*").alias("bins"), F.min(F.when(2 * F.col("cum_asc") >= F.col("total"), F.col("frag_len"))).alias("median"),
        F.min(F.when(share("cum_asc"), F.col("frag_len"))).alias("low"), F.max(F.when(share("cum_desc"), F.col("frag_len"))).alias("high"),
    )
    good = (F.col("n_pairs") >= min_pairs) & (F.col("bins") >= min_bins)
    return c.select("read_group", "n_pairs", *[F.when(good, F.col(x)).alias(x) for x in ("median", "low", "high")])


def length_quality(pairs: DataFrame, hist: DataFrame) -> DataFrame:
    """pairs with frag_quality: -10 log10 of the tail beyond the pair's length; -1 for lengths not in the histogram."""
    c = cumulative(hist)
    cdf = F.col("cum_asc") / F.col("total")
    median = F.min(F.when(2 * F.col("cum_asc") >= F.col("total"), F.col("frag_len"))).over(Window.partitionBy("read_group"))
    tail = c.withColumn("median", median).withColumn("tail", F.when(F.col("frag_len") > F.col("median"), 1 - cdf).otherwise(cdf))
    scored = tail.select("read_group", "frag_len", F.when(F.col("tail") > 0, round_half_up(-10 * F.log10("tail"))).otherwise(99).cast("long").alias("frag_quality"))
    return pairs.join(scored, ["read_group", "frag_len"], "left").withColumn("frag_quality", F.coalesce("frag_quality", F.lit(-1).cast("long")))
