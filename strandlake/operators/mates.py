"""Mates, ids, orders and events over read pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.storage import materialize


def placed(rows: DataFrame, order: list[str], place: str) -> DataFrame:
    """rows with their place from 1 on in a total order.

    A range sort deals the rows into partitions; places count on from the sizes of the partitions before, which are few numbers.
    """
    stored = materialize(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return stored.join(F.broadcast(before), "_part").withColumn(place, (F.col("_before") + own).cast("long")).drop("_part", "_before")


def numbered(names: DataFrame, order: list[str], number: str) -> DataFrame:
    """names with ids from 0 on in the given order."""
    return placed(names, order, number).withColumn(number, F.col(number) - 1)


def concatenated(refs: DataFrame, order: str, length: str, pad: int) -> DataFrame:
    """refs with begins and ends in the text that joins them with pad places between.

    One row a reference; a single task sees their lengths only.
    """
    total = F.sum(F.col(length).cast("long") + pad).over(Window.orderBy(order))
    return refs.withColumn("ends", total - pad).withColumn("begins", F.col("ends") - F.col(length))


def windowed_mates(records: DataFrame, keys: list[str], pos: str, reach: int | None = None) -> DataFrame:
    """(keys, pos, distance): each record with the later ones of its name, nearer than reach if given; an equi-join on the keys.

    With a reach, records also meet by bins of that width, so those of a name that lie apart never become pairs.
    """
    own, later, on = records.select(*keys, pos), records.select(*keys, F.col(pos).alias("_later")), list(keys)
    if reach is not None:
        on.append("_bin")
        own = own.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(pos) / reach), F.floor((F.col(pos) + reach - 1) / reach))))
        later = later.withColumn("_bin", F.floor(F.col("_later") / reach))
    met = own.join(later, on).filter(F.col("_later") > F.col(pos)).withColumn("distance", F.col("_later") - F.col(pos))
    return (met if reach is None else met.filter(F.col("distance") < reach)).select(*keys, pos, "distance")


def cross_mates(records: DataFrame, name: str, turn: str) -> DataFrame:
    """(name, ref_id, other): records whose references name each other, each pair once, by the turn of its earlier record."""
    other = records.select(name, F.col("ref_id").alias("mate_ref"), F.col("mate_ref").alias("ref_id"), F.col(turn).alias("_turn"))
    return records.join(other, [name, "ref_id", "mate_ref"]).filter(F.col(turn) < F.col("_turn")).select(name, "ref_id", F.col("mate_ref").alias("other"))


def conflicts(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """The keys that several tables, or one, give different values."""
    every = reduce(DataFrame.unionByName, tables).distinct()
    return every.groupBy(key).agg(F.count(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).filter("n_values > 1")


def event_extents(members: DataFrame, keys: list[str], median: Column, mate_length: Column) -> DataFrame:
    """From members (keys, side 3 or 5, pos, end) the extents of their events on both sides, their place and uncertainty."""
    three, pos, end = F.col("side") == 3, F.col("pos"), F.col("end")
    sides = {
        "b5": F.when(three, pos).otherwise(end + 1 - median), "e5": F.when(three, end).otherwise(end + mate_length + 1 - median),
        "b3": F.when(three, pos + median - mate_length).otherwise(pos), "e3": F.when(three, pos + median - 1).otherwise(end),
    }
    width = (F.col("e5") - F.col("b5") + F.col("e3") - F.col("b3")).cast("double")
    out = members.withColumns(sides).groupBy(*keys, "side").agg(
        F.min("b5").alias("start5"), F.max("e5").alias("end5"), F.min("b3").alias("start3"), F.max("e3").alias("end3"), F.count("*").alias("members"),
        F.floor(F.sum(width) / (2 * F.count("*")) + 0.5).alias("uncertainty"),
    )
    return out.withColumn("pos", F.when(F.col("side") == 3, F.col("end5")).otherwise(F.col("start3")))
