"""Micro-fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions import sequence as S
from strandlake.operators import cluster, genotype, library, ranges, toolkit
from strandlake.sources import formats
from strandlake.streaming import streams


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], names).select(column.alias("x")).first()["x"]


def test_cigar_and_md(spark):
    c = F.col("c")
    assert one(spark, A.mismatches(A.cigar_sums(c), F.col("m")), c="10S30M2I8M5D20M", m="12A17^ACGTT5C22") == 9
    assert one(spark, A.alignment_end(F.lit(100), A.cigar_sums(c)), c="10S30M2I8M5D20M") == 163
    assert tuple(one(spark, A.clips(A.cigar_sums(c)), c="10S30M4S")) == (10, 4)


def test_mate_tag(spark):
    pair = one(spark, A.mate_tag(F.col("t")), t="<@;60;;AL;1;;><&;37;;;1;;>")
    assert [(x.marker, x.best_mq, x.second_mq, x.special, x.n_map) for x in pair] == [("@", 60, None, "AL", 1), ("&", 37, None, None, 1)]


def test_histogram(spark):
    pairs = spark.createDataFrame([("g", x) for x in [10, 20, 20, 30, 0]], "read_group string, frag_len int")
    r = library.statistics(library.histogram(pairs)).first()
    assert (r.n_pairs, r.median, r.mean) == (4, 20, 20.0)
    assert r.stdev == pytest.approx(math.sqrt(200 / 3))


def test_islands_touch(spark):
    iv = spark.createDataFrame([("k", 0, 5), ("k", 4, 9), ("k", 9, 12), ("k", 14, 15)], "k string, a int, b int")
    assert sorted(tuple(r)[1:] for r in ranges.islands(iv, ["k"], "a", "b").collect()) == [(0, 12, 3), (14, 15, 1)]


def test_gap_merge(spark):
    p = spark.createDataFrame([("k", x) for x in (0, 40, 90, 200)], "k string, p int")
    assert sorted(tuple(r)[1:] for r in ranges.gap_merge(p, ["k"], "p", 50).collect()) == [(0, 40, 2), (90, 90, 1), (200, 200, 1)]


def test_event_sweep(spark):
    p = spark.createDataFrame([("k", x) for x in (0, 40, 90, 200, 200)] + [("m", 5)], "k string, p long")
    assert sorted(tuple(r) for r in ranges.sweep_merge(p, ["k"], "p", 60).collect()) == [("k", 0, 40, 2), ("k", 90, 90, 1), ("k", 200, 200, 2), ("m", 5, 5, 1)]
    assert ranges.sweep_merge(p.limit(0), ["k"], "p", 60).count() == 0


def test_density_and_centres(spark):
    p = spark.createDataFrame([("k", i, x * 2) for i, x in enumerate((0, 1, 2, 10, 11))], "k string, i int, p int")
    assert sorted((r.i, r.density) for r in cluster.densities(p, "k", "i", "p", 3).collect()) == [(0, 2), (1, 3), (2, 2), (3, 2), (4, 2)]
    linked = cluster.centres(p, "k", "i", "p", 3)
    assert sorted((r.i, r.centre) for r in cluster.clusters(linked, "k", "i", 3).collect()) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 3)]


def test_long_chains_end_at_their_root(spark):
    linked = spark.range(300).selectExpr("1 AS k", "id AS i", "1L AS density", "greatest(id - 1, 0) AS centre")
    assert {(r.i, r.centre) for r in cluster.clusters(linked, "k", "i", 6).collect()} == {(i, 0) for i in range(300)}


def test_genotype(spark):
    e = spark.createDataFrame([(0, 0), (5, 5), (10, 0), (0, 10)], "n_ref int, n_alt int")
    assert [r.gt for r in genotype.genotype(e).collect()] == [".", "0/1", "0/0", "1/1"]


def test_sequence_functions(spark):
    s = F.col("s")
    assert one(spark, S.entropy(s), s="ACGT") == 2.0
    assert one(spark, S.entropy(s), s="NNN") == 0.0
    assert one(spark, S.reverse_complement(s), s="AACGN") == "NCGTT"
    assert [(x.pos, x.kmer) for x in one(spark, S.kmers(s, 3), s="ACGNACG")] == [(0, "ACG"), (4, "ACG")]
    assert one(spark, S.family_name(s), s="moblist_AluY.1") == "AluY"
    assert one(spark, S.log10_choose(F.lit(10), F.lit(3)), s="") == pytest.approx(math.log10(120))


def test_rules(spark):
    p = {"a": F.col("a"), "b": F.col("b")}
    rule = toolkit.compile_rule("!a & b | a & !b", p)
    rows = spark.createDataFrame([(x, y) for x in (True, False) for y in (True, False)], "a boolean, b boolean")
    assert sorted((r.a, r.b) for r in rows.filter(rule).collect()) == [(False, True), (True, False)]
    with pytest.raises(ValueError):
        toolkit.compile_rule("(a", p)


def test_formats(spark, tmp_path):
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\tVN:1\nr1\t99\tref\t7\t30\t8M\t=\t37\t39\tTTAGATAA\t*\tMD:Z:8\tNM:i:0\n")
    r = formats.read_sam(spark, str(sam)).first()
    assert (r.name, r.flag, r.pos, r.tags) == ("r1", 99, 7, {"MD": "Z:8", "NM": "i:0"})
    fasta = tmp_path / "x.fa"
    fasta.write_text(">a one\nACG\nT\n>b\nGG\n")
    assert sorted(tuple(r) for r in formats.read_fasta(spark, str(fasta)).collect()) == [("a", "one", "ACGT"), ("b", "", "GG")]
    calls = spark.createDataFrame([("1", 9, ".", "A", "<INS>", ".", "PASS", {"END": "10", "IMPRECISE": ""})], "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info map<string,string>")
    formats.write_vcf(calls, str(tmp_path / "out"))
    assert formats.read_vcf(spark, str(tmp_path / "out")).first().asDict() == calls.first().asDict()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(source))
    stream = streams.first_seen(streams.read_events(spark, str(source), 100))
    got = streams.run_to_table(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.distinct().count() == got.count() == spark.read.parquet(str(source)).select("event_id").distinct().count()


def test_fix_mates_of_unmapped_and_single_records(spark):
    rows = [("a", 1, 0, 10, 20, 1 + 2), ("a", 2, 0, 40, 50, 1 + 2 + 16), ("b", 1, 0, 5, 9, 1 + 2), ("b", 2, 0, 7, 7, 1 + 2 + 4), ("c", 1, 1, 3, 8, 1 + 2 + 32), ("d", 1, 1, 3, 8, 0)]
    got = toolkit.fix_mates(spark.createDataFrame(rows, "name string, line int, ref_id int, pos int, end int, flag int"), "name", ["line"])
    assert [tuple(r) for r in got.select("name", "mate_ref", "mate_pos", "insert", "flag").orderBy("name", "line").collect()] == [
        ("a", 0, 40, 40, 1 + 2 + 32), ("a", 0, 10, -40, 1 + 2 + 16), ("b", 0, 7, 0, 1 + 8), ("b", 0, 5, 0, 1 + 2 + 4), ("c", -1, -1, 0, 1 + 8), ("d", -1, -1, 0, 0),
    ]
