"""Operators on many rows near each other, whose pairs must not become rows."""

import bisect
import random

import numpy as np


from strandlake.operators import callset, cluster


def test_nearest_pair_events_among_dense_ones(spark):
    # all 9e8 pairs lie within reach; they were rows of a join before
    rnd = random.Random(9)
    n = 30_000
    splits = [("a", k, rnd.randint(0, 40_000)) for k in range(n)]
    pairs = [("a", k, at := rnd.randint(0, 40_000), at, at, 50_000 + k % 3) for k in range(n)]
    first = {}
    for _, k, at, *_ in pairs:
        first[at] = min(k, first.get(at, n))
    places = sorted(first)
    s = spark.createDataFrame(splits, "family string, split_id long, pos long")
    p = spark.createDataFrame(pairs, "family string, pair_id long, at long, pos3 long, pos5 long, reach long")
    got = {r.split_id: (r.pair_id, r.distance) for r in callset.nearest_pair_events(s, p, 50_000).collect()}
    for _, k, pos in splits:
        i = bisect.bisect_right(places, pos)
        d, _, place = min((abs(x - pos), x > pos, x) for x in places[max(i - 1, 0) : i + 1])
        assert got[k] == (first[place], d)


def test_mountain_of_dense_points(spark):
    # 1e8 pairs lie in one cell; they were rows of a join, joined once more, before
    rnd = random.Random(4)
    rows = [(rnd.choice("a" * 9 + "b"), k, rnd.randint(0, 400), rnd.randint(0, 60), rnd.choice([300, 500]), rnd.choice([10, 25])) for k in range(12_000)]
    rows += [(None, 90_001, 1, 1, 300, 10), ("a", 90_002, None, 1, 300, 10), ("b", 90_003, -1000, -70, 500, 25)]
    df = spark.createDataFrame(rows, "family string, id long, f long, s long, b1 long, b2 long")
    got = {r.id: (r.density, r.centre) for r in cluster.mountain(df, "family", "id", "f", "s", "b1", "b2").collect()}
    assert len(got) == 12_001
    for family in "ab":
        own = [x for x in rows if x[0] == family and x[2] is not None]
        _, ids, f, s, b1, b2 = (np.array(x) for x in zip(*own, strict=True))
        density = np.array([got[i][0] for i in ids])
        order = np.lexsort((ids, s, f, -density))
        for j in range(0, len(ids), 50):
            near = (abs(f - f[j]) <= b1[j]) & (abs(s - s[j]) <= b2[j])
            assert got[ids[j]] == (near.sum(), ids[order[near[order].argmax()]])
