"""Events of both kinds of evidence brought together, and calls filtered by family, evidence and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import genotype
from strandlake.operators.mates import placed
from strandlake.storage import broadcast_if_small, materialize

c = F.col


def nearest_pair_events(splits: DataFrame, pairs: DataFrame, width: int | None = None) -> DataFrame:
    """(split_id, pair_id, distance): for each split event (family, split_id, pos) the pair event (family, pair_id, at, pos3, pos5, reach) that is nearest.

    The distance is to the nearer of a pair event's two sides and must not pass its own reach. Of equally near ones, one at or before the split event goes
    first, then the closest place, then the smaller id. Places are asked for and told in cells as wide as a reach, where running windows find the next side
    before and behind each; so rows grow with the places and the different reaches of a family, however dense they are. Pair events that differ in id alone
    count once. width is no longer needed.
    """
    sides = F.explode(F.array_distinct(F.array("pos3", "pos5"))).alias("side")
    told = pairs.filter("reach >= 0").select("family", "reach", "at", "pair_id", sides).filter("side IS NOT NULL").groupBy("family", "reach", "side", "at").agg(F.min("pair_id").alias("pair_id"))
    told = materialize(told, "pair-sides")
    cell = lambda at: F.floor(at / F.greatest(c("reach"), F.lit(1))).alias("cell")
    sides = told.select("family", "reach", c("side").cast("long").alias("x"), c("side").cast("long").alias("told"), cell(c("side")))
    # a side within reach lies in the place's own cell or in one beside it, of which the nearest edge is enough
    edges = sides.groupBy("family", "reach", "cell").agg(F.min("told").alias("low"), F.max("told").alias("high"))
    beside = edges.select("family", "reach", F.explode(F.array(F.struct(c("high").alias("x"), (c("cell") + 1).alias("cell")), F.struct(c("low").alias("x"), (c("cell") - 1).alias("cell")))).alias("e"))
    beside = beside.select("family", "reach", "e.x", c("e.x").alias("told"), "e.cell")
    places = splits.select("family", c("pos").cast("long").alias("x")).filter("x IS NOT NULL").distinct()
    asked = places.join(broadcast_if_small(told.select("family", "reach").distinct()), "family").select("family", "reach", "x", F.lit(None).cast("long").alias("told"), cell(c("x")))
    own = Window.partitionBy("family", "reach", "cell").rowsBetween(Window.unboundedPreceding, 0)
    silent = c("told").isNull()  # at equal places sides are told before they are asked for
    down, up = F.max("told").over(own.orderBy("x", silent)), F.min("told").over(own.orderBy(F.desc("x"), silent))
    heard = sides.unionByName(beside).unionByName(asked).withColumns({"down": down, "up": up}).filter(silent)
    met = heard.select("family", "reach", "x", F.explode(F.array_distinct(F.array("down", "up"))).alias("side")).withColumn("distance", F.abs(c("x") - c("side"))).filter(c("distance") <= c("reach"))
    # of all sides that are as near, one on either hand for each reach
    near = met.groupBy("family", "x").agg(F.min("distance").alias("distance"), F.collect_list(F.struct("distance", "reach", "side")).alias("sides"))
    tied = near.select("family", "x", "distance", F.explode(F.filter("sides", lambda s: s["distance"] == c("distance"))).alias("s")).select("family", "x", "distance", "s.reach", "s.side")
    rank = F.struct((c("at") > c("x")).alias("behind"), F.abs(c("at") - c("x")).alias("off"), "pair_id")
    best = tied.join(told, ["family", "reach", "side"]).groupBy("family", "x", "distance").agg(F.min(rank).alias("m"))
    found = splits.join(best.withColumnRenamed("x", "pos"), ["family", "pos"]).groupBy("split_id").agg(F.min(F.struct("distance", "m.behind", "m.off", "m.pair_id")).alias("m"))
    return found.select("split_id", "m.pair_id", "m.distance")


def merged_events(splits: DataFrame, pairs: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(place, family, pos, split_id, pair_id): one stream of events in order of place.

    A split event brings its pair event along, from absorbed (split_id, pair_id); pair events that some split event took don't stand for themselves.
    Of events at one place the lower family goes first, within it pair events, then the smaller id. Places count from 1 on.
    """
    own = splits.join(absorbed.select("split_id", "pair_id"), "split_id", "left").select("family", "pos", "split_id", "pair_id")
    alone = pairs.join(absorbed.select("pair_id").distinct(), "pair_id", "left_anti").select("family", c("at").alias("pos"), F.lit(None).cast(splits.schema["split_id"].dataType).alias("split_id"), "pair_id")
    stream = own.unionByName(alone).withColumn("_split", c("split_id").isNotNull()).withColumn("_id", F.coalesce("split_id", "pair_id"))
    return placed(stream, ["pos", "family", "_split", "_id"], "place").select("place", "family", "pos", "split_id", "pair_id")


def supported_calls(calls: DataFrame, min_pairs: int = 2, min_splits: int = 5, unwanted: tuple[str, ...] = ("PO",), first_genotype: str | None = None) -> DataFrame:
    """calls (rp5, rp3, sr5, sr3, family, ...) with enough evidence and their `call_class`, without those of unwanted families and, if a column is named, those
    whose first sample has no call."""
    kept = genotype.call_filter(calls, min_pairs, min_splits).filter(~c("family").isin(*unwanted))
    return kept if first_genotype is None else kept.filter(~c(first_genotype).startswith("."))


def unmasked_calls(calls: DataFrame, masks: DataFrame, key: str, width: int = 1 << 12) -> DataFrame:
    """calls (key, chrom, pos, end, family, call_class, ...) off the masks (type, window, chrom, start, stop), all half-open.

    A mask whose type is the family of some call holds for calls of that family and class 1 alone; all others hold for every call. A call goes if it comes within
    the mask's window of it. Calls and masks meet in bins of places.
    """
    families = materialize(calls.select("family").distinct(), "families")
    typed = masks.join(broadcast_if_small(families.select(c("family").alias("type"), F.lit(True).alias("own"))), "type", "left")
    wide = typed.select("type", "own", "chrom", (c("start") - c("window")).alias("low"), (c("stop") + c("window")).alias("high"))
    binned = wide.withColumn("bin", F.explode(F.sequence(F.floor(c("low") / width), F.floor((c("high") - 1) / width))))
    slim = calls.select(key, "chrom", "pos", "end", "family", "call_class").withColumn("bin", F.explode(F.sequence(F.floor(c("pos") / width), F.floor((c("end") - 1) / width))))
    met = slim.join(binned, ["chrom", "bin"]).filter((c("pos") < c("high")) & (c("end") > c("low")))
    hit = met.filter(c("own").isNull() | ((c("type") == c("family")) & (c("call_class") == 1))).select(key).distinct()
    return calls.join(hit, key, "left_anti")
