"""Filters by property, formats, files by value and proper pairs."""

import json

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.operators import records as R
from strandlake.plans import catalogue

SCHEMA = "name string, flag int, ref_name string, pos long, map_qual int, cigar string, mate_name string, mate_pos long, insert_size int, bases string, quals string, filename string, tags map<string,string>, ref_id int, mate_ref int, length int"
ROWS = [
    ('a"1', 99, "chr1", 6, 30, "5M1I4M", "chr1", 40, 44, "ACGTACGTAC", "IIII#IIII~", "f.bam", {"XA": "7", "RG": "g1"}, 0, 0, 10),
    ("b", 16, None, 0, 0, "", None, None, 0, "A" * 101, "I" * 101, "f.bam", None, -1, -1, 101),
    ("c", 1 | 8 | 128, "chr2", 9, 5, None, None, 0, 0, None, None, "g.bam", {"XA": "x"}, 1, 0, 0),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_formats_of_records(spark, records):
    record = {x: F.col(x) for x in records.columns}
    got = {r.name: r for r in records.select("name", R.json_text(record).alias("j"), R.yaml_text(record).alias("y"), R.fasta_text(F.col("name"), F.col("flag"), F.col("bases")).alias("fa"), R.fastq_text(F.col("name"), F.col("flag"), F.col("bases"), F.col("quals")).alias("fq")).collect()}
    first = json.loads(got['a"1'].j)
    assert first == {
        "name": 'a"1', "alignmentFlag": "99", "reference": "chr1", "position": 7, "mapQuality": 30, "cigar": ["5M", "1I", "4M"], "mate": {"reference": "chr1", "position": 41, "insertSize": 44}, "queryBases": "ACGTACGTAC",
        "qualities": [40, 40, 40, 40, 2, 40, 40, 40, 40, 93], "filename": "f.bam",
    }
    assert set(json.loads(got["b"].j)) == {"name", "alignmentFlag", "position", "mapQuality", "queryBases", "qualities", "filename"} and "cigar" not in json.loads(got["c"].j)
    assert got["b"].fa == ">b\n" + "T" * 50 + "\n" + "T" * 50 + "\nT" and got['a"1'].fq == '@a"1/1\nACGTACGTAC\n+\nIIII#IIII~'
    assert got["b"].y.startswith("---\nb:\n   Qualities: III") and "   MateRefID: -1\n   MatePosition: \n" in got["b"].y


def test_property_filters(records):
    names = lambda filters, rule=None: {r.name for r in records.filter(R.compile_filters(filters, rule)).collect()}
    assert names({"x": {"isMapped": "true", "isPaired": "true", "isSecondMate": "false"}}) == {'a"1'}
    assert names({"x": {"isSingleton": "true"}}) == {"c"} and names({"x": {"tag": "XA:>5"}}) == {'a"1'} and names({"x": {"tag": "XA:x"}}) == {"c"}
    assert names({"x": {"length": ">10"}, "y": {"reference": "chr2"}}) == {"b", "c"} and names({"x": {"isPaired": "true"}, "y": {"mapQuality": "<10"}}, "x & !y") == {'a"1'}
    for bad in ({"x": {"isMapped": "yes"}}, {"x": {"colour": "red"}}):
        with pytest.raises(ValueError):
            R.compile_filters(bad)
    assert len(R.FLAG_PROPERTIES) + len(R.VALUE_PROPERTIES) + len(["isSingleton", "length", "tag"]) == 24


def test_files_by_value(spark, records, tmp_path):
    for by, want in (("mapped", {"MAPPED": 3}), ("paired", {"PAIRED_END": 2, "SINGLE_END": 1}), ("reference", {"chr1": 1, "chr2": 1, "unmapped": 1}), ("tag:XA", {"7": 1, "x": 1, "none": 1})):
        path = str(tmp_path / by.replace(":", "_"))
        R.write_split(records, path, by)
        assert {r.split: r["count"] for r in spark.read.option("inferSchema", False).parquet(path).groupBy(F.col("split").cast("string").alias("split")).count().collect()} == want


def test_proper_pairs(spark):
    rows = []
    for k in range(60):
        size = 95 + k % 11
        rows += [("g", f"n{k}", 1 | 64 | 32, 0, 0, 30, size), ("g", f"n{k}", 1 | 128 | 16 | 2, 0, 0, 30, size)]
    odd = [("g", "far", 97, 0, 0, 30, 900), ("g", "far", 145, 0, 0, 30, 900), ("g", "low", 97, 0, 0, 0, 100), ("g", "low", 145, 0, 0, 30, 100), ("g", "one", 99, 0, 0, 30, 100), ("h", "x", 97, 0, 0, 30, 100), ("g", "apart", 97, 0, 1, 30, 100), ("g", "apart", 145, 1, 0, 30, 100)]
    df = spark.createDataFrame(rows + odd, "read_group string, name string, flag int, ref_id int, mate_ref int, map_qual int, frag_len int")
    sure = df.filter("read_group = 'g' AND frag_len < 200").select("read_group", "frag_len", A.orientation(F.col("flag")).alias("model"))
    libraries = R.library_models(sure)
    lib = libraries.first()
    assert (lib.low, lib.median, lib.high, lib.ambiguous) == (95, 100, 105, False)
    got = R.mark_proper(df, libraries, "name").collect()
    assert len(got) == len(rows) + len(odd)
    assert {r.name for r in got if r.flag & 2} == {f"n{k}" for k in range(60)} | {"low"} and sum(r.flag & 2 > 0 for r in got) == 121


def test_marked_pairs_of_the_query(spark):
    assert sum(r.proper for r in catalogue.QUERIES["b09_mark_proper"](spark, "/root/testdata/sf0.001").collect()) > 0


def test_trios(spark):
    import random

    from strandlake.functions import families

    rnd = random.Random(3)
    names = families.GENOTYPES
    fits = lambda c, f, m: any(sorted(x + y) == sorted(c) for x in f for y in m)
    assert {(names[k], names[f], names[m]) for k, f, m in families.trios()} == {(c, f, m) for c in names for f in names for m in names if fits(c, f, m)}
    assert all(len(set(names[f])) == 1 and len(set(names[k])) == 1 and set(names[k]) & set(names[m]) for k, f, m in families.trios(True, True))
    rows = [(k, *([rnd.choice([0, 3, 20, rnd.randint(0, 90)]) for _ in range(10)] for _ in range(3))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, c array<int>, f array<int>, m array<int>")
    got = {r.k: r for r in df.select("k", families.trio_call(F.col("c"), F.col("f"), F.col("m")).alias("t"), families.pair_call(F.col("c"), F.col("f")).alias("p"), families.least_difference(F.array("c", "f", "m")).alias("d")).select("k", "t.*", "p", "d").collect()}
    for k, c, f, m in rows:
        cost, *_, best = min((c[x] + f[y] + m[z], z, y, x, (names[x], names[y], names[z])) for x, y, z in families.trios())
        r = got[k]
        assert (r.llr, (r["child"], r.father, r.mother)) == (cost - min(c) - min(f) - min(m), best)
        assert r.free == ",".join(names[x.index(min(x))] for x in (c, f, m)) and r.p == min(x + y for x, y in zip(c, f, strict=True)) - min(c) - min(f)
        assert r.d == min(sorted(x)[1] - sorted(x)[0] for x in (c, f, m))


def test_trios_are_called_in_batches(spark):
    from strandlake.functions import families

    own = lambda low: [float(low), *[50.5 + k for k in range(9)]]
    rows = [(1, own(1), own(2), own(3)), (2, None, own(0), own(0)), (3, [None, *own(0)[1:]], own(0), own(0)), (4, own(0)[:4], own(0), own(0))]
    df = spark.createDataFrame(rows, "k int, c array<double>, f array<double>, m array<double>").select("k", families.trio_call(*map(F.col, "cfm")).alias("t"), families.least_difference(F.array("c", "f")).alias("d"))
    got = {r.k: r for r in df.collect()}
    assert (got[1].t.llr, got[1].t.child, got[1].d) == (0, "AA", 48.5) and all(got[k].t.llr is None and got[k].t.child is None for k in (2, 3, 4))
    # a row's costs are no array of structs that Spark makes for each trio
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_soft_clips(spark):
    df = spark.createDataFrame([("5S10M2I3D4M6S",), ("2H3S4M",), ("4M",), (None,)], "c string")
    tell = lambda padded: [None if r.k is None else [tuple(x) for x in r.k] for r in df.select(A.soft_clips(F.lit(100), F.col("c"), padded).alias("k")).collect()]
    assert tell(False) == [[(5, 5, 100), (6, 24, 117)], [(3, 0, 100)], [], None] and tell(True)[0] == [(5, 5, 100), (6, 24, 119)]


def test_json_text_of_odd_values(spark):
    """Texts with marks to escape, nulls, leading zeros and letters that no CIGAR has; plain texts are written without a JSON generator in lambdas."""
    names = ["plain", 'quo"te', "back\\slash", "tab\tline\n", "\x01", "ü\u2028", None]
    rows = [(n, 1, "chr1", 5, 3, g, "chr2", 7, 9, "ACGT", q, "f") for n in names for g, q in (("007M2I", "I~!"), ("*", ""), (None, None))]
    schema = "name string, flag int, ref_name string, pos long, map_qual int, cigar string, mate_name string, mate_pos long, insert_size long, bases string, quals string, filename string"
    df = spark.createDataFrame(rows, schema)
    shown = df.select("name", "cigar", "quals", R.json_text({x: F.col(x) for x in df.columns}).alias("j"))
    for r in shown.collect():
        own = json.loads(r.j)
        assert own["name"] == r["name"] and own["alignmentFlag"] == "1"
        assert own.get("cigar") == {"007M2I": ["7M", "2I"], "*": []}.get(r.cigar)
        assert own.get("qualities") == ([ord(x) - 33 for x in r.quals] if r.quals else None)
    assert "lambdafunction" not in shown._jdf.queryExecution().optimizedPlan().toString()
