"""Interval operators. Range conditions become equi-joins on bins, so no plan falls back to a nested loop."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.storage import materialize


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, width: int, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Points joined with the closed ranges around them: inner, left_semi or left_anti; only ranges are replicated into bins. strategy is a join hint for the ranges."""
    binned = ranges.withColumn("_bin", F.explode(_bins(F.col(low), F.col(high), width)))
    if how != "inner":
        binned = binned.select(F.col(key).alias("_key"), "_bin", F.col(low).alias("_low"), F.col(high).alias("_high"))
    else:
        binned = binned.withColumnsRenamed({key: "_key", low: "_low", high: "_high"})
    if strategy:
        binned = binned.hint(strategy)
    left = points.withColumn("_at", F.floor(F.col(point) / width))
    on = (left[key] == binned["_key"]) & (left["_at"] == binned["_bin"]) & left[point].between(binned["_low"], binned["_high"])
    joined = left.join(binned, on, how).drop("_at")
    return joined if how != "inner" else joined.drop("_key", "_bin").withColumnsRenamed({"_low": low, "_high": high})


def _runs(rows: DataFrame, keys: list[str], at: str, reach: Column, opens, tile: int) -> DataFrame:
    """rows with `_run`, the place where their run began: a row opens one where opens(place, farthest reach before it) holds.

    Windows run inside tiles of so many places; what goes over to later tiles, the farthest reach and the last opening, is one row a tile.
    """
    tiled = rows.withColumns({"_far": reach, "_tile": F.floor(F.col(at) / tile)})
    own = Window.partitionBy(*keys, "_tile").orderBy(at, "_far")
    so_far = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, column: str, name: str) -> DataFrame:
        ends = df.groupBy(*keys, "_tile").agg(F.max(column).alias("_end"))
        return df.join(ends.select(*keys, "_tile", F.max("_end").over(so_far).alias(name)), [*keys, "_tile"])

    before = F.greatest(F.max("_far").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_earlier"))
    opened = carried(tiled, "_far", "_earlier").withColumn("_reach", before)
    opened = opened.withColumn("_first", F.when(F.col("_reach").isNull() | opens(F.col(at), F.col("_reach")), F.col(at))).drop("_earlier", "_reach")
    told = carried(materialize(opened, "runs"), "_first", "_carried")
    run = F.coalesce(F.max("_first").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    return told.withColumn("_run", run).drop("_carried", "_first", "_far", "_tile")


def islands(intervals: DataFrame, keys: list[str], start: str, end: str, tile: int = 1 << 32) -> DataFrame:
    """Unions of intervals that overlap or touch: keys, island start and end, members. Intervals without a start or end, or a key, are left out."""
    whole = intervals.dropna(subset=[*keys, start, end])
    found = _runs(whole, keys, start, F.col(end), lambda at, reach: at > reach, tile)
    return found.groupBy(*keys, "_run").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count("*").alias("members")).drop("_run")


def gap_merge(points: DataFrame, keys: list[str], point: str, gap: int, tile: int = 1 << 32) -> DataFrame:
    """Runs of points with less than gap between neighbours: keys, first, last, members. Points without a place or key are left out."""
    found = _runs(points.dropna(subset=[*keys, point]), keys, point, F.col(point), lambda at, reach: at - reach >= gap, tile)
    return found.groupBy(*keys, "_run").agg(F.min(point).alias("first"), F.max(point).alias("last"), F.count("*").alias("members")).drop("_run")


def sweep_merge(points: DataFrame, keys: list[str], point: str, reach: int) -> DataFrame:
    """Events of a sweep along each key: keys, first, last, members.

    An event takes all points less than reach beyond its first one; the next begins at the first point it doesn't take. Each
    place points to the place where the event after it would begin; the chain from a key's first place is found by doubling
    the pointers, each round stored, so no task needs a whole key in memory.
    """
    places = materialize(points.groupBy(*keys, F.col(point).alias("_p")).agg(F.count("*").alias("_n")), "sweep-places")
    asked = places.select(*keys, (F.col("_p") + reach).alias("_at"), F.col("_p").alias("_from"), F.lit(None).cast("long").alias("_to"))
    told = places.select(*keys, F.col("_p").alias("_at"), F.lit(None).cast("long").alias("_from"), F.col("_p").cast("long").alias("_to"))
    # from the far end on, the smallest place seen is the next one; at equal places it is told before it is asked for
    order = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    jump = asked.unionByName(told).withColumn("_next", F.min("_to").over(order)).filter("_from IS NOT NULL AND _next IS NOT NULL").select(*keys, F.col("_from").alias("_p"), "_next")
    starts = places.groupBy(*keys).agg(F.min("_p").alias("_p"))
    while True:
        jump = materialize(jump, "sweep-jumps")
        if jump.isEmpty():
            break
        reached = starts.join(jump, [*keys, "_p"]).select(*keys, F.col("_next").alias("_p"))
        starts = materialize(starts.unionByName(reached), "sweep-starts")
        jump = jump.join(jump.select(*keys, F.col("_p").alias("_next"), F.col("_next").alias("_far")), [*keys, "_next"]).select(*keys, "_p", F.col("_far").alias("_next"))
    begun = places.join(starts.withColumn("_start", F.col("_p")), [*keys, "_p"], "left")
    first = F.max("_start").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("first", first).groupBy(*keys, "first").agg(F.max("_p").alias("last"), F.sum("_n").alias("members"))


def depth(intervals: DataFrame, keys: list[str], start: str, end: str, tile: int = 1 << 32) -> DataFrame:
    """Coverage as steps: keys, pos, depth from pos on. Changes are summed per place and per tile; windows run over the few tiles
    of a key and inside tiles, so that no task sees all places of a key."""
    ups = intervals.select(*keys, F.col(start).alias("pos"), F.lit(1).alias("d"))
    downs = intervals.select(*keys, F.col(end).alias("pos"), F.lit(-1).alias("d"))
    steps = ups.unionByName(downs).groupBy(*keys, "pos").agg(F.sum("d").alias("d")).withColumn("_tile", F.floor(F.col("pos") / tile))
    tiles = steps.groupBy(*keys, "_tile").agg(F.sum("d").alias("_d"))
    before = F.sum("_d").over(Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1))
    tiles = tiles.select(*keys, "_tile", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy(*keys, "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(tiles, [*keys, "_tile"]).select(*keys, "pos", (F.col("_before") + F.sum("d").over(order)).alias("depth"))


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, point: str, reach: int) -> DataFrame:
    """One-to-one nearest partners within reach: each left row its nearest right row, each right row its nearest such left row."""
    spread = right.select(F.col(key).alias("_key"), right_id, F.col(point).alias("_at")).withColumn("_bin", F.explode(_bins(F.col("_at") - reach, F.col("_at") + reach, reach)))
    own = left.select(key, left_id, point).withColumn("_own", F.floor(F.col(point) / reach))
    near = own.join(spread, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_bin"))).withColumn("distance", F.abs(F.col(point) - F.col("_at"))).filter(F.col("distance") <= reach)
    first = near.groupBy(key, left_id).agg(F.min(F.struct("distance", right_id)).alias("m")).select(key, left_id, "m.*")
    return first.groupBy(key, right_id).agg(F.min(F.struct("distance", left_id)).alias("m")).select(key, f"m.{left_id}", right_id, "m.distance")


def tiles(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row for each tile an interval covers."""
    return intervals.withColumn("tile", F.explode(_bins(F.col(start), F.col(end) - 1, width)))


def region_tiles(refs: DataFrame, length: str, width: int) -> DataFrame:
    """refs with `start` and `stop` of each of their tiles of width places, from 0, half-open; what is left at the end joins the last tile below 1.1 of a width."""
    n = F.col(length)
    last = F.floor(n / width).cast("long")
    # one tile more where the rest is a tile of its own, one less where nothing is left
    tiles = F.greatest(F.when((n - last * width) * 10 >= width, last + 1).otherwise(last), F.lit(1))
    cut = refs.filter(n > 0).withColumn("_n", tiles).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return cut.withColumns({"start": F.col("_k") * width, "stop": F.when(F.col("_k") == F.col("_n") - 1, n).otherwise((F.col("_k") + 1) * width)}).drop("_k", "_n")


_REGION = re.compile(r"([^:]+)(?::(\d+)(?:-(\d+))?)?")


def in_region(region: str, ref: Column, start: Column, end: Column) -> Column:
    """`name`, `name:first` or `name:first-last`, counted from 1, as a condition on half-open records counted from 0."""
    found = _REGION.fullmatch(region)
    if not found:
        raise ValueError(f"no region: {region!r}")
    name, first, last = found.groups()
    out = ref == name
    if first:
        out = out & (end > int(first) - 1)
    return out & (start < int(last)) if last else out


def best_run(points: DataFrame, key: str, order: list[str], score: Column) -> DataFrame:
    """(key, best): the highest sum of scores over neighbouring rows, 0 at least, as the largest rise of the running sum."""
    w = Window.partitionBy(key).orderBy(*order)
    summed = points.select(key, *order, F.sum(score).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    lowest = F.least(F.min("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rise = summed.select(key, F.greatest(F.col("_sum") - lowest, F.lit(0)).alias("_rise"))
    return rise.groupBy(key).agg(F.max("_rise").alias("best"))
