"""Connected components of links, as joins and aggregations with stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b): label is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label's own label, so that long chains fold
    up in a logarithmic number of rounds. Rounds are stored in the shared folder.
    """
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = materialize(ends, "links")
    labels = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).withColumn("label", F.least("id", "label"))
    labels = materialize(labels, "labels")
    while True:
        near = ends.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        # a root takes the smallest label any of its members sees, so whole trees hook at once
        seen = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("near"))
        root = seen.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("low"))
        hooked = seen.join(root, F.col("label") == F.col("root")).select("id", F.col("label").alias("old"), F.col("low").alias("label"))
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("up"))
        following = hooked.join(up, "label").select("id", "old", F.least("label", "up").alias("label"))
        following = materialize(following, "labels")
        if following.filter("old <> label").isEmpty():
            return following.select("id", "label")
        labels = following.select("id", "label")
