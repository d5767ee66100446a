"""Alignment, best runs and population statistics against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.functions import pairwise
from strandlake.operators import population, ranges
from strandlake.plans import catalogue


def plain_score(ref, read, match=2, mismatch=2, gap_open=3, gap_extend=1):
    """Every cell by its definition, gaps of every length tried."""
    h = [[0] * (len(ref) + 1) for _ in range(len(read) + 1)]
    cost = lambda n: gap_open + (n - 1) * gap_extend
    for i in range(1, len(read) + 1):
        for j in range(1, len(ref) + 1):
            h[i][j] = max(
                0, h[i - 1][j - 1] + (match if read[i - 1] == ref[j - 1] else -mismatch),
                *(h[i - n][j] - cost(n) for n in range(1, i + 1)), *(h[i][j - n] - cost(n) for n in range(1, j + 1)),
            )
    return max(map(max, h))


def rescored(ref, read, found):
    score, j, j_end, i, i_end, cigar = found
    total = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            total += sum(2 if read[i + x] == ref[j + x] else -2 for x in range(n))
        else:
            total -= 3 + (n - 1)
        i, j = i + n * (op != "D"), j + n * (op != "I")
    assert (i - 1, j - 1) == (i_end, j_end)
    return total


def test_local_alignment(spark):
    assert pairwise.smith_waterman("TTACGTACGTTT", "ACGTACGT")[:5] == (16, 2, 9, 0, 7)
    assert pairwise.smith_waterman("AAA", "CC") == (0, None, None, None, None, "")
    rng = random.Random(5)
    for _ in range(150):
        ref, read = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 24))) for _ in range(2))
        found = pairwise.smith_waterman(ref, read)
        assert found[0] == plain_score(ref, read)
        assert not found[0] or rescored(ref, read, found) == found[0]
    rows = spark.createDataFrame([("TTACGTTT", "ACGT"), (None, "A"), ("", "A")], "r string, q string")
    got = rows.select(pairwise.local_alignment(F.col("r"), F.col("q")).alias("a")).select("a.*").collect()
    assert [(r.score, r.cigar) for r in got] == [(8, "4M"), (None, None), (0, "")]


def test_best_runs(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate((4, -6, 10, -4, 6))] + [("m", 0, -3)], "k string, i int, x int")
    assert sorted(tuple(r) for r in ranges.best_run(rows, "k", ["i"], F.col("x")).collect()) == [("k", 12), ("m", 0)]
    cigar = spark.createDataFrame([("2=1I5=2X3=",), (None,), ("4X",)], "c string").select(pairwise.best_cigar_score(F.col("c")).alias("x"))
    assert [r.x for r in cigar.collect()] == [10, None, 0]


def test_fisher(spark):
    def plain(a, b, c, d):
        p = {k: math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)}
        return sum(x for x in p.values() if x <= p[a] * (1 + 1e-7)) / sum(p.values())

    rng = random.Random(3)
    for _ in range(200):
        cells = [rng.randint(0, 12) for _ in range(4)]
        assert population.exact_p(*cells) == pytest.approx(plain(*cells))
    rows = spark.createDataFrame([(3, 1, 1, 3), (None, 1, 1, 1)], "a long, b long, c long, d long")
    assert [r.p for r in rows.select(population.fisher_exact(*map(F.col, "abcd")).alias("p")).collect()] == [pytest.approx(plain(3, 1, 1, 3)), None]


def test_allele_frequency(spark):
    samples = [[(-0.1, -1.0, -4.0), (-3.0, -0.2, -2.0)], [(-5.0, -2.0, 0.0)], []]
    rows = spark.createDataFrame([(x,) for x in samples], "gl array<struct<gl_0:double,gl_1:double,gl_2:double>>")
    got = [r.f for r in rows.select(population.allele_frequency(F.col("gl"), 30).alias("f")).collect()]
    for own, f in zip(samples[:2], got, strict=False):
        want = 0.5
        for _ in range(30):
            w = [((1 - want) ** 2 * 10**a, 2 * want * (1 - want) * 10**b, want**2 * 10**c) for a, b, c in own]
            want = sum((y + 2 * z) / (x + y + z) for x, y, z in w) / (2 * len(own))
        assert f == pytest.approx(want)
    assert got[2] is None


def test_region():
    with pytest.raises(ValueError):
        ranges.in_region(":3", None, None, None)


@pytest.mark.parametrize("name", ["u01_smith_waterman", "x02_allele_frequency", "x05_fisher"])
def test_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_line_is_evidence(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    choose = lambda n, k: (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(10)
    want = {}
    for (site, sample), own in lines.groupby(["l_suppkey", "l_linestatus"]):
        r, a = int((own.l_returnflag == "N").sum()), int((own.l_returnflag == "R").sum())
        want[site, sample] = (r, a, *(choose(r + a, a) + r * math.log10(p) + a * math.log10(1 - p) if r + a else -0.48 for p in (0.999, 0.5, 0.001)))
    got = {(x.site, x.sample): (x.n_ref, x.n_alt, x.gl_0, x.gl_1, x.gl_2) for x in catalogue.j11_genotype(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert sum(x[0] + x[1] for x in got.values()) == int(lines.l_returnflag.isin(["N", "R"]).sum())
