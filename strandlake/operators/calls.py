"""Filters and statistics over variant calls (chrom, pos, ref, alt and further columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def plain_sites(calls: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Calls whose reference is of A, C, G and T alone; with sites (chrom, pos), only those listed there."""
    kept = calls.filter(F.upper("ref").rlike("^[ACGT]+$"))
    return kept if sites is None else kept.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def with_previous(calls: DataFrame, width: int = 1 << 16) -> DataFrame:
    """calls with `previous`: the place of the call before on the chromosome, null for the first. Calls without a place are left out.

    Windows run within tiles of so many places; the last place of a tile, one row each, goes over to the next tile.
    """
    tiled = calls.filter("chrom IS NOT NULL AND pos IS NOT NULL").withColumn("tile", F.floor(c("pos") / width))
    ends = tiled.groupBy("chrom", "tile").agg(F.max("pos").alias("end"))
    ends = ends.select("chrom", "tile", F.lag("end").over(Window.partitionBy("chrom").orderBy("tile")).alias("before"))
    own = F.lag("pos").over(Window.partitionBy("chrom", "tile").orderBy("pos"))
    return tiled.join(ends, ["chrom", "tile"]).withColumn("previous", F.coalesce(own, "before")).drop("tile", "before")


def linkage_statistics(calls: DataFrame, r: Column, least: float = 0.9) -> DataFrame:
    """(chrom, strong, fraction, length): neighbouring calls linked by more than least, their share of the calls with an r, and their summed distance."""
    strong = (c("r") > least) & (c("pos") > c("previous"))
    found = with_previous(calls.select("chrom", "pos", r.alias("r"))).groupBy("chrom").agg(
        F.count_if(strong).alias("strong"), F.count("r").alias("n"), F.coalesce(F.sum(F.when(strong, c("pos") - c("previous"))), F.lit(0)).alias("length")
    )
    return found.select("chrom", "strong", F.when(c("n") > 0, c("strong") / c("n")).alias("fraction"), "length")


def quality_classes(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(qual, n, snps, transitions, joint), each summed over all calls of that quality or better; known (chrom, pos) makes the joint ones.

    Calls with a longer or unknown reference or a longer first alternative are left out; an unknown or negative quality counts as 3.
    The running sums go over distinct qualities, one row each, not over calls.
    """
    ref, alt = F.upper("ref"), F.upper("alt")
    first = F.split(alt, ",")[0]
    single = calls.filter((F.length("ref") == 1) & (ref != "N") & (F.length(first) == 1))
    listed = known.select("chrom", "pos").distinct().withColumn("known", F.lit(True))
    snp = (alt != ".") & (alt != ref)
    change = F.concat(ref, first).isin("AG", "GA", "CT", "TC")
    quality = F.when(c("qual").isNull() | (c("qual") < 0), 3).otherwise(c("qual"))
    counted = single.join(listed, ["chrom", "pos"], "left").groupBy(quality.alias("qual")).agg(
        F.count("*").alias("n"), F.count_if(snp).alias("snps"), F.count_if(change).alias("transitions"), F.count_if(c("known")).alias("joint")
    )
    down = Window.orderBy(F.desc("qual"))
    return counted.select("qual", *[F.sum(x).over(down).alias(x) for x in ("n", "snps", "transitions", "joint")])


def transition_ratio(snps: Column, transitions: Column) -> Column:
    """Transitions over transversions; 100 without a transversion."""
    return F.when(snps == transitions, 100.0).otherwise(transitions / (snps - transitions))


def filter_codes(depth: Column, alternative: Column, quality: Column, depths: tuple[int, int] = (2, 10_000_000), least_alternative: int = 2, least_quality: int = 10) -> Column:
    """0 for a call that passes; 4 with too few alternative bases, 2 and 3 with too low or high a depth, 1 with too low a mapping quality. Nulls pass."""
    return F.when(alternative < least_alternative, 4).when(depth < depths[0], 2).when(depth > depths[1], 3).when(quality < least_quality, 1).otherwise(0)


def near_gaps(calls: DataFrame, near: int = 3, apart: int = 10) -> DataFrame:
    """calls (chrom, pos, ref, alt, score, code) with codes of 0 turned to 5 for substitutions near a gap and to 6 for gaps beside a better one.

    A substitution goes if it starts at most `near` bases behind a gap, or ends as close before one that passes. Of two passing gaps at most `apart`
    bases from each other, the one of the lower score goes, of equal scores the later. Each pair is judged by the codes given, not by what
    other pairs decide. Calls meet in small tiles of places, so only neighbours become rows.
    """
    span = F.length("ref") - 1
    gap = F.exists(F.split("alt", ","), lambda x: F.length(x) != F.length("ref"))
    width = 2 * max(near, apart)
    reach = c("pos") + c("span") + max(near, apart)
    own = calls.withColumns({"span": span, "gap": gap})
    slim = own.select("chrom", "pos", "span", "gap", "score", "code").withColumn("tile", F.explode(F.sequence(F.floor(c("pos") / width), F.floor(reach / width))))
    # of a pair, the later call's first tile is always one of the earlier call's
    later = own.select("chrom", F.floor(c("pos") / width).alias("tile"), *[c(x).alias(f"b_{x}") for x in ("pos", "gap", "score", "code")])
    met = slim.join(later, ["chrom", "tile"]).filter((c("b_pos") > c("pos")) & (c("b_pos") <= reach) & (c("gap") | c("b_gap")))
    close, beside = c("pos") + c("span") + near >= c("b_pos"), c("pos") + c("span") + apart >= c("b_pos")
    rival = c("gap") & c("b_gap") & (c("code") == 0) & (c("b_code") == 0) & beside
    earlier_goes = (~c("gap") & (c("b_code") == 0) & close) | (rival & (c("score") < c("b_score")))
    later_goes = (~c("b_gap") & close) | (rival & (c("score") >= c("b_score")))
    hit = met.select("chrom", F.explode(F.array(F.when(earlier_goes, c("pos")), F.when(later_goes, c("b_pos")))).alias("pos")).filter("pos IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    marked = own.join(hit, ["chrom", "pos"], "left")
    code = F.when((c("code") == 0) & c("hit"), F.when(c("gap"), 6).otherwise(5)).otherwise(c("code"))
    return marked.withColumn("code", code).drop("span", "gap", "hit")
