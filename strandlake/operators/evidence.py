"""From sites and fragments to genotyping evidence, and from clipped reads to split events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import ranges
from strandlake.storage import dealt_for_sorting

#: A site is kept with so many read pairs on both sides, or so many split reads.
MIN_PAIRS, MIN_SPLITS = 2, 5


def locus_fragments(sites: DataFrame, fragments: DataFrame, reach: int, beyond: int) -> DataFrame:
    """Fragments (ref_id, start, ...) with the sites (ref_id, site, pos, ...) they may speak for: those that start from reach before a
    site to beyond behind it. Sites are dealt into bins, fragments stay single rows. Both sides are shuffled by bins, so that what is counted by
    site behind the join has a task's own sites as groups, not all sites that a part of the file meets."""
    around = sites.withColumns({"_low": F.col("pos") - reach, "_high": F.col("pos") + beyond})
    return ranges.point_in_range(fragments, around, "ref_id", "start", "_low", "_high", reach + beyond, strategy="shuffle_hash")


def evidence(met: DataFrame, keys: list[str], min_qual: int, side: int) -> DataFrame:
    """Counts by keys of the fragments met at a site: reads across it and normal fragments over it speak against, short fragments and
    the site's own pairs and clipped reads for it. A fragment can count in two ways."""
    c = F.col
    half = F.when(c("precise"), 0).otherwise(F.floor(c("uncertainty") / 2))
    low, high = c("pos") - half, c("pos") + half
    fit = c("same_ref") & (c("fragment_end") >= high)
    across = fit & c("precise") & (c("map_qual") >= min_qual) & ~c("soft") & (c("pos") - c("start") > side) & (c("read_end") - c("pos") > side)
    over = fit & c("upstream") & (c("near_end") <= high) & (c("far_start") >= low)
    pair, n = c("special") & (F.abs(c("start") - c("pos")) <= side), F.count_if
    major = c("soft") & (F.abs(c("start") - c("pos")) <= side)
    out = met.groupBy(*keys).agg(
        (n(across) + n(over & (c("kind") == "NORMAL"))).alias("non_support"), n(over & (c("kind") == "SHORT")).alias("short"),
        n(pair & ~c("reverse")).alias("rp3"), n(pair & c("reverse")).alias("rp5"), n(major & ~c("reverse")).alias("sr3"), n(major & c("reverse")).alias("sr5"),
    )
    return out.withColumn("support", sum((c(x) for x in ("rp3", "rp5", "sr3", "sr5")), c("short"))).drop("short")


def supported(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The sites whose samples together have enough pairs on both sides, or enough split reads."""
    both = (F.sum("rp3") >= MIN_PAIRS) & (F.sum("rp5") >= MIN_PAIRS)
    return counts.groupBy(*keys).agg((both | (F.sum("sr3") + F.sum("sr5") >= MIN_SPLITS)).alias("_fit")).filter("_fit").drop("_fit")


def partials(records: DataFrame, min_clip: int) -> DataFrame:
    """A row for each clipped end of (ref_id, pos, end, lead, trail, family, reverse): its side, and the aligned range it leaves."""
    ends = F.array(F.struct(F.lit(5).alias("side"), F.col("lead").alias("clip")), F.struct(F.lit(3).alias("side"), F.col("trail").alias("clip")))
    return records.withColumn("_p", F.explode(F.filter(ends, lambda x: x["clip"] >= min_clip))).select("ref_id", "pos", "end", "family", "reverse", "_p.*")


def split_events(found: DataFrame, major_clip: int) -> DataFrame:
    """Islands of partials on a reference: their extent, sides, major members, longest clip, and the poll of their families and strands.

    The family and strand most partials agree on wins, the first in order if several; agree is its share. Partials are counted first and
    dealt by reference into tasks of like size, which windows and polls share.
    """
    found = dealt_for_sorting(found, found.count(), "ref_id")
    order = Window.partitionBy("ref_id").orderBy("pos", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.when(F.col("pos") <= reach, 0).otherwise(1))
    own = marked.withColumn("event", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    votes = own.groupBy("ref_id", "event", "family", "reverse").agg(
        F.count("*").alias("n"), F.min("pos").alias("start"), F.max("end").alias("stop"), F.count_if(F.col("side") == 3).alias("n3"), F.count_if(F.col("side") == 5).alias("n5"),
        F.count_if(F.col("clip") >= major_clip).alias("major"), F.max("clip").alias("clip"),
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "family", "reverse"))
    return votes.groupBy("ref_id", "event").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n3").alias("n3"), F.sum("n5").alias("n5"), F.sum("major").alias("major"), F.max("clip").alias("longest_clip"),
        best.alias("_best"), F.sum("n").alias("_all"),
    ).select("ref_id", "start", "stop", "n3", "n5", "major", "longest_clip", "_best.family", "_best.reverse", (-F.col("_best.n") / F.col("_all")).alias("agree"))


def seed_regions(hits: DataFrame, k: int, least: int) -> DataFrame:
    """Runs of k-mer hits (query, ref, query_pos, ref_pos) along a diagonal, of least bases or more: query, ref, begin, ref_begin, length."""
    # one shuffle serves equal hits, runs and regions
    along = hits.repartition("query", "ref").distinct().withColumn("_diagonal", F.col("ref_pos") - F.col("query_pos"))
    order = Window.partitionBy("query", "ref", "_diagonal").orderBy("query_pos")
    run = F.col("query_pos") - F.row_number().over(order)
    found = along.withColumn("_run", run).groupBy("query", "ref", "_diagonal", "_run").agg(F.min("query_pos").alias("begin"), (F.count("*") + k - 1).alias("length"))
    return found.filter(F.col("length") >= least).select("query", "ref", "begin", (F.col("begin") + F.col("_diagonal")).alias("ref_begin"), "length")


def longest_by_end(regions: DataFrame) -> DataFrame:
    """Of the regions of a query that end at one place the longest, the first in order of ref and ref_begin if several."""
    row = F.struct((-F.col("length")).alias("n"), "ref", "ref_begin", "begin")
    best = regions.groupBy("query", (F.col("begin") + F.col("length") - 1).alias("end")).agg(F.min(row).alias("b"))
    return best.select("query", "end", "b.ref", "b.ref_begin", "b.begin", (-F.col("b.n")).alias("length"))


def percentile_index(share: float, n: Column) -> Column:
    """The place, from 1 on, of a share of n sorted values."""
    return F.least(F.floor(n * share) + 1, n)
