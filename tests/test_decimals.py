"""Values as call files show them, against what C prints."""

import random

from pyspark.sql import functions as F

from strandlake.sources import formats


def test_two_decimals_as_c_prints_them(spark):
    rnd = random.Random(3)
    values = [0.125, 0.375, 2.675, 1.005, -1.285, 0.005, 0.015, 0.0, -0.001, -0.125, 99.995, 1e14, 0.004999, 123456.785]
    values += [s * round(rnd.uniform(0, 400), 3) for _ in range(3000) for s in (1, -1)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", formats.two_decimals(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["%.2f" % r.x for r in rows]
