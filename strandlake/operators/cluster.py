"""Density clustering of discordant pairs: neighbours are counted, each point follows its densest neighbour to a centre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.storage import materialize

#: Pairs of points that a task compares at once, those of so many rows; widest bounds in a tile.
BLOCK, ROWS, TILE = 1 << 18, 128, 32


def _around(places: DataFrame, key: str, point: str, bound: int, value: Column, gather) -> DataFrame:
    """(key, point, found): gather of value over the places within bound of each place, itself included.

    The axis is cut into cells of twice the bound: what lies around a place is the end of one cell and the beginning of the next, and
    both are running windows inside the cells. So rows grow with the places, however dense they are; three are shuffled for each.
    """
    width = 2 * bound
    told = places.select(key, F.col(point).alias("_at"), value.alias("_v"), F.lit(None).cast("long").alias("_for"), F.lit(None).cast("boolean").alias("_low"))
    asked = [places.select(key, (F.col(point) + step).alias("_at"), F.lit(None).cast(told.schema["_v"].dataType).alias("_v"), F.col(point).cast("long").alias("_for"), F.lit(step < 0).alias("_low")) for step in (-bound, bound)]
    rows = told.unionByName(asked[0]).unionByName(asked[1]).withColumn("_cell", F.floor(F.col("_at") / width))
    own = Window.partitionBy(key, "_cell").rowsBetween(Window.unboundedPreceding, 0)
    heard = F.col("_for").isNotNull()  # at equal places values are told before they are asked for
    down, up = own.orderBy(F.desc("_at"), heard), own.orderBy("_at", heard)
    answered = rows.withColumns({"_down": gather(F.col("_v")).over(down), "_up": gather(F.col("_v")).over(up)}).filter(heard)
    return answered.groupBy(key, F.col("_for").alias(point)).agg(gather(F.when(F.col("_low"), F.col("_down")).otherwise(F.col("_up"))).alias("found"))


def densities(points: DataFrame, key: str, row: str, point: str, bound: int) -> DataFrame:
    """(key, row, density): how many points of the key lie within bound, the point itself included."""
    places = points.groupBy(key, point).agg(F.count("*").alias("_n"))
    dense = _around(places, key, point, bound, F.col("_n"), F.sum)
    return points.select(key, row, point).join(dense, [key, point]).select(key, row, F.col("found").alias("density"))


def centres(points: DataFrame, key: str, row: str, point: str, bound: int) -> DataFrame:
    """(key, row, density, centre): the neighbour of highest density, the first in order of place and row if several."""
    places = points.groupBy(key, point).agg(F.count("*").alias("_n"), F.min(row).alias("_row"))
    dense = materialize(_around(places, key, point, bound, F.col("_n"), F.sum).join(places, [key, point]).select(key, point, "_row", F.col("found").alias("density")), "densities")
    rank = F.struct((-F.col("density")).alias("d"), F.col(point).alias("p"), F.col("_row").alias("r"))
    best = _around(dense, key, point, bound, rank, F.min).select(key, point, F.col("found.r").alias("centre"))
    return points.select(key, row, point).join(dense.join(best, [key, point]), [key, point]).select(key, row, "density", "centre")


def clusters(linked: DataFrame, key: str, row: str, hops: int = 1) -> DataFrame:
    """Points with the root of their chain of centres: pointer jumping, each hop doubles the reach.

    Rounds go on, each materialized, until no centre changes; hops is how many are made at least.
    """
    own, done = linked, 0
    while True:
        up = own.select(F.col(key), F.col(row).alias("centre"), F.col("centre").alias("up"))
        jumped = materialize(own.join(up, [key, "centre"]).select(key, row, "density", F.col("up").alias("centre"), (F.col("up") != F.col("centre")).alias("_moved")), "clusters")
        moved, own, done = not jumped.filter("_moved").isEmpty(), jumped.drop("_moved"), done + 1
        if not moved and done >= hops:
            return own


def statistics(members: DataFrame, keys: list[str], value: str, min_members: int = 2, min_std: float = -1.0) -> DataFrame:
    """keys, members, mean, std (of the population), lowest and highest of clusters with so many members and a wider spread; -1 asks for no spread."""
    own = members.groupBy(*keys).agg(
        F.count(value).alias("members"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return own.filter((F.col("members") >= min_members) & (F.col("std") > min_std))


def strand_vote(pairs: DataFrame, keys: list[str], side: str, reverse: Column) -> DataFrame:
    """keys and sense: a pair on side 3 votes +1 where its mate is reverse, one on side 5 where it is forward, else -1."""
    agrees = F.when(F.col(side) == 3, reverse).otherwise(~reverse)
    return pairs.groupBy(*keys).agg(F.sum(F.when(agrees, 1).otherwise(-1)).alias("sense"))


def _within(asked: pd.DataFrame, told: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks of asked rows (f, s, b1, b2) and of told rows (f, s), both sorted by f, with a table of which of these lie within the bounds of those; blocks hold
    about BLOCK pairs."""
    f, s, b1, b2 = (asked[x].to_numpy() for x in ("f", "s", "b1", "b2"))
    g, t = told["f"].to_numpy(), told["s"].to_numpy()
    for i in range(0, len(asked), ROWS):
        own = slice(i, i + ROWS)
        low, high = np.searchsorted(g, (f[own] - b1[own]).min()), np.searchsorted(g, (f[own] + b1[own]).max(), "right")
        for j in range(low, high, max(1, BLOCK // ROWS)):
            part = slice(j, min(high, j + max(1, BLOCK // ROWS)))
            yield own, part, (np.abs(f[own, None] - g[part]) <= b1[own, None]) & (np.abs(s[own, None] - t[part]) <= b2[own, None])


def _counted(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if asked.empty:  # a tile's edge alone
        return pd.DataFrame({x: asked.get(x, []) for x in ("key", "row", "f", "s", "b1", "b2")} | {"density": []})
    asked, told = asked.sort_values("f"), told.sort_values("f")
    n, density = told["n"].to_numpy().astype(np.float64), np.zeros(len(asked), np.int64)
    for own, part, near in _within(asked, told):
        density[own] += (near @ n[part]).astype(np.int64)
    return asked.assign(density=density)[density > 0].drop(columns="tile")


def _led(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if asked.empty:  # a tile's edge alone
        return pd.DataFrame({x: asked.get(x, []) for x in ("key", "row", "density")} | {"centre": []})
    asked, told = asked.sort_values("f"), told.sort_values(["rank", "f", "s", "row"])
    rows = told["row"].to_numpy()
    told = told.assign(place=np.arange(len(told))).sort_values("f")
    place, best = told["place"].to_numpy(), np.full(len(asked), len(told))
    for own, part, near in _within(asked, told):
        best[own] = np.minimum(best[own], np.where(near, place[part], len(told)).min(axis=1))
    return asked[["key", "row", "density"]].assign(centre=rows[best])


def mountain(points: DataFrame, key: str, row: str, first: str, second: str, bound_1: str, bound_2: str) -> DataFrame:
    """(key, row, density, centre) in two dimensions, each point with its own bounds: its density counts the points within them, its
    centre is the one of these with the highest density, the first in order of first, second and row if several.

    A centre always ranks before its point, so chains of centres have no rings. Points meet in tiles of TILE times the widest bound, places near an edge
    also in the next one; pairs are compared in blocks inside a task and never become rows, so about two rows a point are shuffled, twice. A task
    holds the places of one tile of a key. Points at one place are told once.
    """
    width = int(points.agg(F.max(bound_1)).first()[0] or 1)
    kind = {x.name: x.dataType.simpleString() for x in points.schema}
    named = points.select(F.col(key).alias("key"), F.col(row).alias("row"), *[F.col(x).alias(y) for x, y in ((first, "f"), (second, "s"), (bound_1, "b1"), (bound_2, "b2"))]).dropna(subset=["key", "f", "s"])
    tile = lambda at: F.floor(at / (TILE * width))

    def met(asked: DataFrame, told: DataFrame, gather, schema: str) -> DataFrame:
        # both sides come from the same points: told columns get attributes of their own
        spread = told.select(*[F.col(x).alias(x) for x in told.columns]).withColumn("tile", F.explode(F.sequence(tile(F.col("f") - width), tile(F.col("f") + width))))
        return asked.withColumn("tile", tile(F.col("f"))).groupBy("key", "tile").cogroup(spread.groupBy("key", "tile")).applyInPandas(gather, schema)

    own = f"key {kind[key]}, row {kind[row]}, f {kind[first]}, s {kind[second]}, b1 {kind[bound_1]}, b2 {kind[bound_2]}, density long"
    dense = materialize(met(named.dropna(), named.groupBy("key", "f", "s").agg(F.count("*").alias("n")), _counted, own), "mountain")
    lead = dense.groupBy("key", "f", "s").agg(F.min(F.struct((-F.col("density")).alias("rank"), "row")).alias("m")).select("key", "f", "s", "m.*")
    best = met(dense, lead, _led, f"key {kind[key]}, row {kind[row]}, density long, centre {kind[row]}")
    return best.withColumnsRenamed({"key": key, "row": row})


def finalized(linked: DataFrame, key: str, row: str, min_density: int) -> DataFrame:
    """(key, centre, root_density, members) of clusters whose root is dense enough."""
    roots = linked.filter(F.col(row) == F.col("centre")).select(key, "centre", F.col("density").alias("root_density"))
    members = clusters(linked, key, row).groupBy(key, "centre").agg(F.count("*").alias("members"))
    return members.join(roots.filter(F.col("root_density") >= min_density), [key, "centre"])
