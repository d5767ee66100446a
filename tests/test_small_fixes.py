"""Readers of odd files, tiles of regions, mates by bins, pairs that go together and the exact test of large tables."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import mates, population, ranges, toolkit
from strandlake.sources import formats


def test_fasta_with_a_mark_inside_a_description(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x > y\nACGT\nAC\n>two\nG\n\n>three >\r\nTT\r\n")
    got = sorted((r.name, r.description.strip(), r.seq) for r in formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("one", "x > y", "ACGTAC"), ("three", ">", "TT"), ("two", "", "G")]


def test_vcf_with_a_repeated_key(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n1\t5\t.\tA\tC\t.\t.\tDP=3;FLAG;DP=4;AF=0.5\n")
    assert formats.read_vcf(spark, str(tmp_path / "a.vcf")).first().info == {"DP": "3", "FLAG": "", "AF": "0.5"}


def test_header_names_every_field(spark):
    lines = formats.vcf_header(["s1", "s2"])
    ids = [line.split("ID=")[1].split(",")[0] for line in lines if "ID=" in line]
    assert ids[:4] == ["INS:ME:AL", "INS:ME:L1", "INS:ME:SV", "INS:ME:HE"] and ids[4:13] == ["TYPE", "IMPRECISE", "STRAND", "CIPOS", "MEILEN", "RP5", "RP3", "SR5", "SR3"]
    assert ":".join(ids[13:]) == formats.SAMPLE_FORMAT and lines[-1].endswith("FORMAT\ts1\ts2")


def test_region_tiles(spark):
    def plain(n, width):
        at, out = 0, []
        while at < n:
            end = n if (n - at) * 10 < 11 * width else at + width
            out.append((at, end))
            at = end
        return out

    sizes = [*range(45), 109, 110, 111, 1000]
    for width in (10, 7):
        got = {}
        for r in ranges.region_tiles(spark.createDataFrame([(n,) for n in sizes], "n long"), "n", width).collect():
            got.setdefault(r.n, []).append((r.start, r.stop))
        assert {n: sorted(x) for n, x in got.items()} == {n: plain(n, width) for n in sizes if n}


def test_mates_within_reach_meet_in_bins(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randint(-50, 200)) for _ in range(120)]
    df = spark.createDataFrame(rows, "name string, pos long")
    for reach in (1, 7, 40):
        got = sorted(map(tuple, mates.windowed_mates(df, ["name"], "pos", reach).collect()))
        assert got == sorted((n, p, q - p) for n, p in rows for m, q in rows if m == n and 0 < q - p < reach)


def test_a_dropped_duplicate_takes_its_mate_along(spark):
    rows = [("a", 1, 5, 100, 9), ("a", 2, 90, -100, 9), ("b", 1, 5, 100, 7), ("b", 2, 95, -100, 60), ("c", 1, 6, 100, 1), ("d", 1, 5, 100, 9)]
    df = spark.createDataFrame(rows, "name string, line int, pos int, insert int, qual int")
    kept = toolkit.drop_duplicate_pairs(df, ["pos", "insert"], "name", F.col("insert") > 0, [-F.col("qual"), F.col("name")])
    assert {(r.name, r.line) for r in kept.collect()} == {("a", 1), ("a", 2), ("c", 1)}


def test_exact_p_of_large_and_lopsided_tables():
    assert population.exact_p(10**8, 10**8 + 20_000, 10**8, 10**8) == pytest.approx(0.3174, abs=1e-3)
    assert population.exact_p(10**6, 10, 10, 10**6) < 1e-300
    assert population.exact_p(0, 0, 0, 0) == population.exact_p(0, 5, 0, 7) == 1.0
    assert population.exact_p(3, 1, 1, 3) == pytest.approx(0.4857142857)


def test_place_interval(spark):
    df = spark.createDataFrame([(10, 20, 30, 40), (10, 35, 30, 40)], "a int, b int, c int, d int")
    got = df.select(formats.place_interval((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in got] == [(-10, 20), (-20, 10)]


def test_islands_and_gaps_cross_tiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), a := rnd.randint(-40, 300), a + rnd.choice([0, 1, 4, 4, 60])) for _ in range(90)] + [(None, 1, 2), ("a", None, 3), ("c", 5, None), ("d", 7, 9)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    islands, runs = [], []
    for key in "abd":
        mine = sorted((a, b) for k, a, b in rows if k == key and a is not None)
        for a, b in mine:
            if islands and islands[-1][0] == key and a <= islands[-1][2]:
                islands[-1] = (key, islands[-1][1], max(b, islands[-1][2]), islands[-1][3] + 1)
            else:
                islands.append((key, a, b, 1))
            if runs and runs[-1][0] == key and a - runs[-1][2] < 3:
                runs[-1] = (key, runs[-1][1], a, runs[-1][3] + 1)
            else:
                runs.append((key, a, a, 1))
    for tile in (5, 50, 1 << 32):
        assert sorted(map(tuple, ranges.islands(df, ["k"], "a", "b", tile).collect())) == sorted(islands)
        assert sorted(map(tuple, ranges.gap_merge(df.filter("k <> 'c'"), ["k"], "a", 3, tile).collect())) == sorted(runs)


def test_fragments_meet_sites_in_shuffled_bins(spark):
    # a broadcast of the sites would leave groups of all sites to the counts in each part of the file
    from strandlake.operators import evidence

    sites = spark.createDataFrame([(k, 0, 10 * k) for k in range(30)], "site long, ref_id int, pos long")
    fragments = spark.createDataFrame([(0, k, k % 2) for k in range(0, 320, 3)], "ref_id int, start long, sample int")
    met = evidence.locus_fragments(sites, fragments, 50, 5).groupBy("site").agg(F.count("*").alias("n"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    want = {k: sum(10 * k - 50 <= s <= 10 * k + 5 for s in range(0, 320, 3)) for k in range(30)}
    assert {r.site: r.n for r in met.collect()} == want


def test_sorted_tasks_grow_in_number(spark, monkeypatch):
    from strandlake import storage
    from strandlake.operators import evidence, pileup

    monkeypatch.setattr(storage, "SORTED_ROWS", 4)
    found = spark.createDataFrame([(k % 25, k, k + 3, "A", False, 3 + k % 2 * 2, 9) for k in range(100)], "ref_id int, pos long, end long, family string, reverse boolean, side int, clip int")
    events = evidence.split_events(found, 8)
    assert "REPARTITION_BY_NUM" in (plan := events._jdf.queryExecution().executedPlan().toString()) and ", 25)" in plan
    assert events.agg(F.sum(F.col("n3") + F.col("n5"))).first()[0] == 100 and events.count() == 100
    records = spark.range(20).selectExpr("id", "0 AS ref_id", "id AS pos", "'2M' AS cigar", "'AC' AS seq")
    assert ", 20)" in pileup.pileup(records, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_site_counts_are_made_once_for_genotypes(spark):
    from strandlake.plans import catalogue

    plan = catalogue.QUERIES["j11_locus_genotypes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("site-counts") == 2
