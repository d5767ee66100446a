"""Headers, lists, masks, several files and SAM output; streams against their batch twins."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandlake.functions import pairs as P
from strandlake.functions import sequence as S
from strandlake.operators import cluster, evidence, mates, ranges, toolkit
from strandlake.sources import formats
from strandlake.streaming import streams

HEADER = "@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:chr2\tLN:90\tM5:AB\n@SQ\tSN:chr10\tLN:70\n@RG\tID:g1\tSM:s1\tPL:ILLUMINA\n"
LINE = "{}\t99\t{}\t{}\t30\t8M\t=\t37\t39\tTTAGATAA\t*\tMD:Z:8\tNM:i:0\n"


def test_headers(spark, tmp_path):
    (tmp_path / "a.sam").write_text(HEADER + LINE.format("r1", "chr10", 7))
    groups, refs, order = formats.read_header(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in groups.collect()] == [("g1", "s1", "ILLUMINA")]
    assert [tuple(r) for r in refs.collect()] == [("chr2", 90, "AB"), ("chr10", 70, None)] and order.first().order == "coordinate"
    (tmp_path / "b.sam").write_text("@RG\tID:g1\tPL:X\n")
    with pytest.raises(Exception, match="no SM"):
        formats.read_header(spark, str(tmp_path / "b.sam"))[0].collect()
    assert formats.rewritten_header(["@HD\tSO:coordinate", "@SQ\tSN:x"], "me") == ["@HD\tSO:unsorted", "@SQ\tSN:x", "@PG\tID:me"]
    assert formats.output_path("x") == "x.mei.vcf" and formats.output_path(None) is None
    assert formats.vcf_header(["s1"])[-1].split("\t")[-2:] == ["FORMAT", "s1"]


def test_several_files(spark, tmp_path):
    (tmp_path / "a.sam").write_text(HEADER + LINE.format("r1", "chr10", 7) + LINE.format("r2", "chr2", 9))
    (tmp_path / "b.sam").write_text(HEADER + LINE.format("r3", "chr2", 3))
    (tmp_path / "c.sam").write_text("@SQ\tSN:other\tLN:5\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.sam\n\n{tmp_path}/b.sam\n")
    paths = formats.read_list(spark, str(tmp_path / "list"))
    rows = formats.read_many_sam(spark, paths)
    assert [r.name for r in rows.collect()] == ["r3", "r2", "r1"]
    with pytest.raises(ValueError):
        formats.read_many_sam(spark, [*paths, str(tmp_path / "c.sam")])
    formats.write_sam(rows.drop("ref_id"), str(tmp_path / "out"))
    again = formats.read_sam(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.drop("ref_id").collect()))


def test_masks(spark, tmp_path):
    (tmp_path / "x.bed").write_text("1\t5\t9\tn\n#c\n2\t1\t3\tm\n")
    (tmp_path / "masks").write_text(f"# all of them\nALU 20 {tmp_path}/x.bed\n")
    assert sorted(tuple(r) for r in formats.read_masks(spark, str(tmp_path / "masks")).collect()) == [("ALU", 20, "1", 5, 9), ("ALU", 20, "2", 1, 3)]
    (tmp_path / "masks").write_text("ALU far x.bed\n")
    with pytest.raises(ValueError):
        formats.read_masks(spark, str(tmp_path / "masks"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_orders_and_tokens(spark):
    names = ["chr10", "chr2", "chrX", "chrUn", "chrY", "r9a", "r10a", "r010a"]
    assert [one(spark, P.chromosome_rank(F.lit(n))) for n in names[:5]] == [10, 2, 23, 0, 24]
    assert one(spark, P.natural_key(F.lit("r9a"))) < one(spark, P.natural_key(F.lit("r10a"))) == one(spark, P.natural_key(F.lit("r010a")))
    token = lambda value, t, number=False: one(spark, toolkit.token_condition(F.lit(value), t, number))
    assert token("abc", "*bc") and token("abc", "a*") and token("abc", "*b*") and token("abc", "!x") and not token("abc", "ab")
    assert token("7", ">=7", True) and token("7", "!>7", True) and token("7", "7", True) and not token("7", "<7", True)
    with pytest.raises(ValueError):
        P.detection_set(0, ["a"])


def test_factorials(spark):
    import math

    for n in (0, 1, 20, 21, 170, 5_000_000):
        assert one(spark, S.log10_factorial(F.lit(n))) == pytest.approx(math.lgamma(n + 1) / math.log(10), abs=1e-8, rel=1e-12)


def test_places_and_ids(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v int")
    assert sorted(tuple(r) for r in mates.placed(rows, ["v"], "place").collect()) == [(1, 1), (3, 2), (5, 3), (9, 4)]
    assert mates.numbered(rows.limit(0), ["v"], "id").count() == 0
    refs = spark.createDataFrame([(0, 10), (1, 5)], "ref_id int, length int")
    assert sorted((r.begins, r.ends) for r in mates.concatenated(refs, "ref_id", "length", 300).collect()) == [(0, 10), (310, 315)]


def test_mountain_has_own_bounds(spark):
    """The first point reaches the others, they don't reach it; a point too far in the second dimension stands alone."""
    points = spark.createDataFrame([("k", 1, 0, 0, 9, 5), ("k", 2, 8, 0, 2, 5), ("k", 3, 9, 0, 2, 5), ("k", 4, 9, 50, 2, 5)], "k string, i int, f int, s int, a int, b int")
    linked = cluster.mountain(points, "k", "i", "f", "s", "a", "b")
    assert sorted((r.i, r.density, r.centre) for r in linked.collect()) == [(1, 3, 1), (2, 2, 2), (3, 2, 2), (4, 1, 4)]
    assert sorted((r.centre, r.root_density, r.members) for r in cluster.finalized(linked, "k", "i", 2).collect()) == [(1, 3, 1), (2, 2, 2)]


def test_seed_regions(spark):
    hits = spark.createDataFrame([(1, 7, 3, 13), (1, 7, 4, 14), (1, 7, 4, 14), (1, 7, 5, 15), (1, 7, 9, 19), (1, 8, 3, 3)], "query int, ref int, query_pos int, ref_pos int")
    regions = evidence.seed_regions(hits, 4, 4)
    assert sorted((r.ref, r.begin, r.ref_begin, r.length) for r in regions.collect()) == [(7, 3, 13, 6), (7, 9, 19, 4), (8, 3, 3, 4)]
    assert sorted((r.end, r.ref, r.length) for r in evidence.longest_by_end(regions).collect()) == [(6, 8, 4), (8, 7, 6), (12, 7, 4)]


def test_depth_over_tiles(spark):
    iv = spark.createDataFrame([("k", 0, 25), ("k", 5, 15), ("m", 7, 9)], "k string, a long, b long")
    whole = sorted(map(tuple, ranges.depth(iv, ["k"], "a", "b").collect()))
    assert whole == sorted(map(tuple, ranges.depth(iv, ["k"], "a", "b", tile=6).collect())) == [("k", 0, 1), ("k", 5, 2), ("k", 15, 1), ("k", 25, 0), ("m", 7, 1), ("m", 9, 0)]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    rows = [(1, at(0), 5, "click", 1.0, ""), (2, at(10), 5, "purchase", 2.0, ""), (3, at(300), 6, "click", 3.0, ""), (4, at(305), 5, "click", 3.0, ""), (5, at(900), 7, "purchase", 1.0, ""), (6, at(901), 7, "purchase", 1.0, ""), (7, at(1500), 8, "click", 9.0, ""), (8, at(1501), 8, "refund", 9.0, "")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(folder / "all"))
    return str(folder / "all")


def run(spark, frame, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_stream_of_mates(spark, events, tmp_path):
    met = streams.mates(streams.read_events(spark, events, 1), "user_id", F.col("event_type") == "click", F.col("event_type") == "purchase")
    got = {(r.event_id_1, r.event_id_2) for r in run(spark, met, tmp_path, "append")}
    # the pair is found, and clicks alone come once their time has passed
    assert (1, 2) in got and (3, None) in got and not any(b == 5 for _, b in got)


def test_stream_of_sessions(spark, events, tmp_path):
    got = {(r.user_id, r.n) for r in run(spark, streams.sessions(streams.read_events(spark, events, 1), "user_id"), tmp_path, "append")}
    assert (5, 2) in got and (6, 1) in got


def test_stream_of_counts(spark, events, tmp_path):
    stream = streams.read_events(spark, events, 2)
    got = {(r.event_type, r.value): r.n for r in run(spark, streams.running_histogram(stream, "event_type", F.col("value")), tmp_path / "a", "complete")}
    assert got == {("click", 1.0): 1, ("purchase", 2.0): 1, ("click", 3.0): 2, ("purchase", 1.0): 2, ("click", 9.0): 1, ("refund", 9.0): 1}
    windows = run(spark, streams.windowed_counts(streams.read_events(spark, events, 100)), tmp_path / "b", "complete")
    assert sum(r.n for r in windows) == 8


def test_stream_of_value_runs(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    kinds = ["click", "click", "view", "view", "click", "view", "view", "view", "click", "click", "view", "click"]
    rows = [(k, at(7 * k), k % 2, kinds[k], 1.0, "") for k in range(12)] + [(12, at(5000), 9, "end", 1.0, ""), (13, at(9000), 9, "end", 1.0, "")]
    for k in range(0, len(rows), 3):  # batches in order of time
        spark.createDataFrame(rows[k : k + 3], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.value_runs(streams.read_events(spark, str(tmp_path / "in"), 1), "user_id", "event_type")
    got = sorted(tuple(r) for r in run(spark, stream, tmp_path, "append"))
    whole = streams.value_runs_batch(spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type")
    want = sorted(tuple(r) for r in whole.select("user_id", "event_type", "first", "last", "n").collect())
    # the last key's run is still open; all others came, those at the end by their timer
    assert got == [x for x in want if x[0] != 9] and len(got) == 9
