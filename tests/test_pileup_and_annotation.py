"""Pileups, depths, densities and special hits against plain versions."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.operators import annotation, cluster, pileup
from strandlake.plans import catalogue


def plain_walk(pos, cigar, seq):
    """{place: (base, begins, ends, next, n)} of one alignment, base by base."""
    ops = [(int(n), "M" if op in "=X" else op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    out, read = {}, 0
    for k, (n, op) in enumerate(ops):
        if op in "MD":
            for i in range(n):
                first, last = i == 0, i == n - 1
                after = ops[k + 1] if k + 1 < len(ops) else None
                second = ops[k + 2] if k + 2 < len(ops) else None
                indel = after is not None and after[1] in "ID"
                ends = op == "M" and last and (after is None or after[1] in "SNH" or (indel and (second is None or second[1] in "SNH")))
                out[pos + i] = (seq[read + i] if op == "M" else "*", op == "M" and first and (k == 0 or ops[k - 1][1] in "NSH"), ends, after[1] if op == "M" and last and indel else None, after[0] if op == "M" and last and indel else 0)
        pos += n * (op in "MDN")
        read += n * (op in "MIS")
    return out


def test_pileup_equals_a_walk_base_by_base(spark):
    rnd = random.Random(1)
    rows = [(0, 1, 4090, "5S10M2D3M1I4M3N6M2H", "ACGTA" * 6), (1, 1, 4095, "3=1X2D", "ACGT"), (2, 2, 5, None, "AC"), (3, 2, None, "2M", "AC")]
    for k in range(4, 80):
        ops = rnd.choice(["5M", "3S7M", "4M1D4M", "4M2I4M3S", "2H3M2N3M", "3M2I", "6=2X3D1M", "2M3D"])
        rows.append((k, rnd.randint(1, 2), rnd.randint(4080, 4110), ops, "".join(rnd.choice("ACGTN") for _ in range(30))))
    df = spark.createDataFrame(rows, "id int, ref_id int, pos long, cigar string, seq string")
    want: dict = {}
    for k, ref, pos, cigar, seq in rows:
        if pos is not None and cigar:
            for place, x in plain_walk(pos, cigar, seq).items():
                want.setdefault((ref, place), []).append((k, x))
    counts = {(r.ref_id, r.pos): r for r in pileup.base_counts(df, ["id"]).collect()}
    columns = {(r.ref_id, r.pos): r for r in pileup.pileup(df, ["id"]).collect()}
    assert counts.keys() == columns.keys() == want.keys()
    for at, xs in want.items():
        r, shown = counts[at], ""
        for _, (base, begins, ends, gap, n) in sorted(xs):
            shown += ("^" if begins else "") + base + {"I": f"+{n}", "D": f"-{n}", None: ""}[gap] + ("$" if ends else "")
        assert columns[at].column == shown and columns[at].depth == len(xs)
        assert [r[b] for b in "ACGTN"] == [sum(x[0] == b for _, x in xs) for b in "ACGTN"]
        assert (r.deleted, r.begins, r.ends) == tuple(sum(f(x) for _, x in xs) for f in (lambda x: x[0] == "*", lambda x: x[1], lambda x: x[2]))
        assert (r.insertions, r.deletions) == tuple(sum(x[3] == g for _, x in xs) for g in "ID")


def test_pileup_shuffles_runs_not_bases(spark):
    seq = "ACGT" * 250
    df = spark.range(300).selectExpr("id", "1 AS ref_id", "100L + id AS pos", "'1000M' AS cigar", f"'{seq}' AS seq")
    found = pileup.base_counts(df, ["id"])
    assert found.agg(F.sum("depth")).first()[0] == 300_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(0") < plan.index("REPARTITION_BY_COL")  # outer operators are printed first


def test_bases_never_become_rows(spark):
    df = spark.createDataFrame([(1, 1, 5, "3M", "ACG")], "id int, ref_id int, pos long, cigar string, seq string")
    plan = pileup.pileup(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "collect_list" not in plan
    # a count's rows are expanded from blocks of places, behind the counting
    plan = pileup.base_counts(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(0") < plan.index("MapInArrow")


def test_equal_keys_odd_reads_and_places_in_parts(spark, monkeypatch):
    # equal keys go by what is shown; a read without bases shows gaps, beyond its end nothing
    rows = [(1, 1, 0, "3M", "TTT"), (1, 1, 0, "3M", "ACG"), (None, 1, 1, "2M", "\u00e9G"), (2, 1, 0, "3M", None), (3, 1, 0, "1M2I2M", "A"), (4, None, 0, "1M", "C")]
    df = spark.createDataFrame(rows, "id int, ref_id int, pos long, cigar string, seq string")
    got = {(r.ref_id, r.pos): (r.depth, r.column) for r in pileup.pileup(df, ["id"]).collect()}
    assert got == {(1, 0): (4, "^A^T^*^A+2"), (1, 1): (5, "^\u00e9CT*"), (1, 2): (5, "G$G$T$*$$"), (None, 0): (1, "^C$")}
    counts = {(r.ref_id, r.pos): r for r in pileup.base_counts(df, ["id"]).collect()}
    assert [counts[1, 1][x] for x in ("depth", "A", "C", "deleted", "begins")] == [4, 0, 1, 1, 1]
    piece = pa.RecordBatch.from_pylist(
        [{"ref_id": 7, "tile": 0, "id": k, "start": k, "len": 20, "bases": "ACGTN" * 4, "begins": True, "ends": False, "next": "D", "next_len": 3} for k in range(30)]
    )
    whole = pa.Table.from_batches(pileup._columns(piece, ["id"], 0)).to_pydict()
    monkeypatch.setattr(pileup, "AT_ONCE", 25)
    parts = list(pileup._columns(piece, ["id"], 0))
    assert len(parts) > 20 and pa.Table.from_batches(parts).to_pydict() == whole


def test_depths_cross_tiles_and_skip_empty_intervals(spark):
    rows = [(1, 5, 30, 0), (1, 12, 12, 0), (1, 10, 11, 1), (1, 29, 40, 1), (2, -3, 2, 1), (None, 1, 3, 0)]
    df = spark.createDataFrame(rows, "ref int, a long, b long, s int")
    want: dict = {}
    for ref, a, b, s in rows:
        for p in range(a, b):
            want.setdefault((ref, p), [0, 0])[s] += 1
    got = {(r.ref, r.pos): [r.depth_0, r.depth_1] for r in pileup.depths(df, "ref", "a", "b", "s", [0, 1], tile=8).collect()}
    assert got == want


def test_sums_of_a_cigar(spark):
    row = spark.createDataFrame([("10S30M2I8M5D20M4S",), ("7S",), ("",), (None,)], "c string").select(A.cigar_sums(F.col("c")).alias("s")).collect()
    assert (row[0].s["M"], row[0].s["D"], row[0].s["parts"], row[0].s["lead"], row[0].s["trail"]) == (58, 5, 7, 10, 4)
    assert (row[1].s["lead"], row[1].s["trail"], row[2].s["parts"]) == (7, 0, 0) and row[3].s is None


def test_one_parse_a_plan(spark):
    for name in ("f18_roles", "p03_cigar_values", "f14_problematic", "b16_convert_bed"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, name


def test_densities_and_centres_of_a_dense_place(spark):
    rnd = random.Random(7)
    points = [(k, "a" if k % 9 else "b", rnd.choice([50, 50, 51, rnd.randint(0, 400), rnd.randint(-60, 60)])) for k in range(500)] + [(500, "c", 3), (501, None, 4)]
    df = spark.createDataFrame(points, "row long, key string, at long")
    for bound in (1, 7, 40):
        near = {r: [(k2, r2, a2) for r2, k2, a2 in points if k2 == k and abs(a2 - a) <= bound] for r, k, a in points if k}
        got = {r.row: r.density for r in cluster.densities(df, "key", "row", "at", bound).collect()}
        assert got == {r: len(x) for r, x in near.items()}
        linked = {r.row: (r.density, r.centre) for r in cluster.centres(df, "key", "row", "at", bound).collect()}
        assert linked == {r: (len(x), min((-len(near[r2]), a2, r2) for _, r2, a2 in x)[2]) for r, x in near.items()}


def test_best_cover_pairs(spark):
    rnd = random.Random(8)
    rows = [(q, rnd.randint(0, 60), rnd.choice([0, 5, 9, 9, 20, rnd.randint(1, 40)])) for q in range(40) for _ in range(rnd.randint(1, 9))]
    want = {}
    for q in range(40):
        mine = sorted((b, n) for k, b, n in rows if k == q and n)
        pairs = [(min(x[1] + y[1], y[0] + y[1] - x[0]), -i, j, *x, *y) for i, x in enumerate(mine) for j, y in enumerate(mine) if i < j]
        if pairs:
            want[q] = max(pairs)
    got = {r["query"]: r for r in annotation.best_cover_pairs(spark.createDataFrame(rows, "query int, begin int, length int")).collect()}
    assert got.keys() == want.keys()
    for q, (cover, _, _, *x) in want.items():
        assert (got[q].begin, got[q].length, got[q].other_begin, got[q].other_length, got[q].cover) == (*x, cover)


def test_special_hits(spark):
    rnd = random.Random(9)
    bases = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    turn = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    library = [(k, bases(300)) for k in range(5)]
    reads = []
    for k in range(40):
        inside = library[k % 5][1][100 : 100 + (60 if k % 4 else 15)]
        read = bases(20) + inside + bases(10)
        reads.append((k, turn(read) if k % 3 == 0 else read))
    reads += [(90, ""), (91, None), (92, "ACG")]
    got = {r.id: r for r in annotation.special_hits(spark.createDataFrame(reads, "id int, read string"), spark.createDataFrame(library, "ref_id int, seq string")).collect()}
    assert got.keys() == {k for k in range(40) if k % 4}
    assert all(r.ref_id == k % 5 and r.turned == (k % 3 == 0) and r.score >= 100 and r.length >= 60 for k, r in got.items())


def test_special_hits_look_up_long_kmers(spark, monkeypatch):
    """Only k-mers of `least` bases become rows, and the longest runs of 7-mers are found all the same."""
    rnd = random.Random(12)
    bases = lambda n: "".join(rnd.choice("AACCGTTN" if n % 2 else "AT") for _ in range(n))
    turn = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    library = [(k, bases(150 + k)) for k in range(6)]
    reads = []
    for k in range(60):
        own, at = library[k % 6][1], rnd.randint(0, 90)
        read = bases(9) + own[at : at + rnd.randint(15, 50)] + bases(11)
        reads.append((k, turn(read) if k % 3 == 0 else read))
    made = []
    monkeypatch.setattr(annotation, "seed_regions", lambda hits, *x, own=annotation.seed_regions: made.append(hits.count()) or own(hits, *x))
    got = {r.id: (r.turned, r.ref_id, r.begin, r.length) for r in annotation.special_hits(spark.createDataFrame(reads, "id int, read string"), spark.createDataFrame(library, "ref_id int, seq string"), required=0).collect()}
    want, shared = {}, 0
    for k, read in reads:
        for turned, seq in ((False, read), (True, turn(read))):
            found = []
            for ref, own in library:
                hits = {(i, j) for i in range(len(seq) - 6) for j in range(len(own) - 6) if seq[i : i + 7] == own[j : j + 7] and "N" not in seq[i : i + 7]}
                shared += sum(seq[i : i + 20] == own[j : j + 20] and "N" not in seq[i : i + 20] for i in range(len(seq) - 19) for j in range(len(own) - 19))
                for i, j in hits:
                    if (i - 1, j - 1) not in hits:
                        n = next(n for n in range(1, 200) if (i + n, j + n) not in hits) + 6
                        found += [(-n, ref, j, i)] if n >= 20 else []
            if found and k not in want:
                want[k] = (turned, min(found)[1], min(found)[3], -min(found)[0])
    assert got == want and len(want) > 30
    assert made == [shared]


def plain_tags(seq, ref, cigar):
    md, same, nm, i, j = "", 0, 0, 0, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for k in range(n):
                if seq[i + k] == ref[j + k] != "N":
                    same += 1
                else:
                    md, same, nm = f"{md}{same}{ref[j + k]}", 0, nm + 1
        elif op == "D":
            md, same, nm = f"{md}{same}^{ref[j : j + n]}", 0, nm + n
        elif op == "I":
            nm += n
        i, j = i + n * (op in "M=XIS"), j + n * (op in "M=XDN")
    return md + str(same), nm


def test_difference_tags(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(200):
        cigar = rnd.choice(["20M", "5S10M2D3M1I4M3N6M2H", "3=1X5M", "2M1D1M1D2M", "4M2I4M3S", "2D5M"])
        ref = "".join(rnd.choice("ACGTN") for _ in range(40))
        rows.append((k, "".join(rnd.choice([b, b, b, "A"]) for b in ref), ref, cigar))
    df = spark.createDataFrame([*rows, (900, None, "A", "1M"), (901, "A", None, "1M"), (902, "A", "A", None)], "k int, seq string, ref string, cigar string")
    got = {r.k: r.t for r in df.select("k", A.difference_tags(F.col("seq"), F.col("ref"), F.col("cigar")).alias("t")).collect()}
    assert all(got[k] is None for k in (900, 901, 902))
    assert {k: (got[k].md, got[k].nm) for k, *_ in rows} == {k: plain_tags(*x) for k, *x in rows}
    # what MD and CIGAR tell together is NM again
    told = df.filter("k < 900").select("k", A.difference_tags(F.col("seq"), F.col("ref"), F.col("cigar")).alias("t"), A.cigar_sums(F.col("cigar")).alias("s"))
    assert told.filter(A.mismatches(F.col("s"), F.col("t.md")) != F.col("t.nm")).count() == 0
