"""Filters and statistics over calls on small tables, odd rows and all."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import calls

SCHEMA = "chrom string, pos long, ref string, alt string, qual int, r double"


def test_previous_goes_over_tiles(spark):
    rows = [("a", p, "A", "C", 1, 0.95) for p in (3, 4, 9, 55, 300)] + [("b", 7, "A", "C", 1, None), (None, 5, "A", "C", 1, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.chrom, x.pos): x.previous for x in calls.with_previous(df, width=10).collect()}
    assert got == {("a", 3): None, ("a", 4): 3, ("a", 9): 4, ("a", 55): 9, ("a", 300): 55, ("b", 7): None}
    found = {x.chrom: (x.strong, x.fraction, x.length) for x in calls.linkage_statistics(df, F.col("r")).collect()}
    assert found == {"a": (4, 0.8, 297), "b": (0, None, 0)}
    assert calls.linkage_statistics(df.limit(0), F.col("r")).count() == 0


def test_quality_classes(spark):
    rows = [("a", 1, "a", "g", 50, None), ("a", 2, "A", "C", None, None), ("a", 3, "C", ".", 20, None), ("a", 4, "N", "C", 90, None), ("a", 5, "AC", "A", 90, None), ("a", 6, "G", "A,T", -1, None)]
    known = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3)], "chrom string, pos long")
    got = calls.quality_classes(spark.createDataFrame(rows, SCHEMA), known).orderBy(F.desc("qual")).collect()
    assert [tuple(x) for x in got] == [(50, 1, 1, 1, 1), (20, 2, 1, 1, 2), (3, 4, 3, 2, 2)]
    ratios = spark.createDataFrame([(3, 2), (2, 2)], "s int, t int").select(calls.transition_ratio(F.col("s"), F.col("t")).alias("x")).collect()
    assert [x.x for x in ratios] == [2.0, 100.0]


def test_plain_sites(spark):
    df = spark.createDataFrame([("a", 1, "acg", "T", 1, None), ("a", 2, "R", "T", 1, None), ("a", 3, None, "T", 1, None), ("b", 1, "A", "T", 1, None)], SCHEMA)
    assert [(x.chrom, x.pos) for x in calls.plain_sites(df).orderBy("chrom").collect()] == [("a", 1), ("b", 1)]
    sites = spark.createDataFrame([("a", 1), ("a", 1)], "chrom string, pos long")
    assert calls.plain_sites(df, sites).count() == 1


@pytest.mark.parametrize(("row", "code"), [((10, 5, 30), 0), ((10, 1, 30), 4), ((1, 5, 30), 2), ((9, 5, 3), 1), ((50, 5, 3), 3), ((None, None, None), 0)])
def test_filter_codes(spark, row, code):
    df = spark.createDataFrame([row], "d int, a int, q int")
    assert df.select(calls.filter_codes(F.col("d"), F.col("a"), F.col("q"), depths=(2, 40)).alias("x")).first().x == code


def test_near_gaps_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("ab"), p, rng.choice(["A", "A", "AC", "ACGTACGTACGTACGTACGTACGTACGT"]), rng.choice(["C", "C", "CTT", "C,GG"]), rng.randint(0, 4), rng.choice([0, 0, 0, 4])) for p in range(0, 400, 3)]

    def gap(x):
        return any(len(a) != len(x[2]) for a in x[3].split(","))

    want = {}
    for x in rows:
        code = x[5]
        for y in rows:
            if code or x is y or x[0] != y[0]:
                continue
            first, last = sorted((x, y), key=lambda v: v[1])
            distance = last[1] - first[1] - len(first[2]) + 1
            if not gap(x):
                code = 5 if gap(y) and distance <= 3 and (y is first or y[5] == 0) else 0
            elif gap(y) and y[5] == 0 and distance <= 10 and (y[4] > x[4] or (y[4] == x[4] and y is first)):
                code = 6
        want[x[1]] = code
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, score int, code int")
    got = {x.pos: x.code for x in calls.near_gaps(df).collect()}
    assert got == want
    assert {5, 6} <= set(want.values())
    assert calls.near_gaps(df.limit(0)).count() == 0


def test_two_bit_key(spark):
    df = spark.createDataFrame([("A",), ("ACGT",), ("T" * 31,), ("AN",), ("",), (None,)], "k string")
    assert [x.x for x in df.select(S.two_bit_key(F.col("k")).alias("x")).collect()] == [0, 27, 4**31 - 1, None, None, None]
