"""Likelihoods, linkage, spectra, merged events and masked calls against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import callset, likelihoods


def plain_likelihoods(bases):
    """Base by base, from (base 0-3, strand, quality); tails of the binomial are summed as they are."""
    n, w, seen, total = len(bases), {}, [0] * 4, [0.0] * 4
    for q, s, b in sorted(((q, s, b) for b, s, q in bases), reverse=True):
        e = 10 ** (-max(4, min(63, q)) / 10)
        tail = lambda k: math.fsum(math.comb(n, i) * e**i * (1 - e) ** (n - i) for i in range(k, n + 1))
        surprise = -10 * math.log10(tail(seen[b] + 1) / tail(seen[b]))
        total[b] += (0.83 ** w.get((s, b), 0) * 0.97 + 0.03) * surprise
        seen[b] += 1
        w[s, b] = w.get((s, b), 0) + 1
    out = []
    for j in range(4):
        for k in range(j, 4):
            own = 0 if j == k else -4.343 * (math.log(math.comb(seen[j] + seen[k], seen[k])) - math.log(2) * (seen[j] + seen[k]))
            out.append(max(0.0, own + sum(total[i] for i in range(4) if i not in (j, k))))
    return out


def test_base_likelihoods(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for site in range(25):
        bases = [(rnd.choice([0, 0, 0, 2, rnd.randrange(4)]), rnd.randrange(2), rnd.choice([0, 2, 4, 20, 30, 40, 63, 70])) for _ in range(rnd.choice([1, 2, 9, 40]))]
        want[site] = plain_likelihoods(bases)
        rows += [(site, "ACGT"[b], bool(s), q) for b, s, q in bases]
    df = spark.createDataFrame([*rows, (3, "N", True, 30), (3, None, True, 30), (4, "A", None, None)], "site int, base string, reverse boolean, qual int")
    got = {r.site: list(r)[2:] for r in likelihoods.base_likelihoods(df, ["site"]).collect()}
    assert got.keys() == want.keys()
    for site in want:
        assert got[site] == pytest.approx(want[site], rel=1e-6, abs=1e-6)


def test_deep_sites_stay_small(spark):
    deep = spark.range(200_000).selectExpr("1 AS site", "CASE WHEN id % 2 = 0 THEN 'C' ELSE 'A' END AS base", "id % 4 < 2 AS reverse", "CAST(20 + id % 20 AS INT) AS qual")
    row = likelihoods.base_likelihoods(deep, ["site"]).first()
    assert row.depth == 200_000 and row.gl_AC < row.gl_AA < row.gl_GG


def plain_linkage(a, b):
    """One pair by loops over samples and haplotypes."""

    def start(p):
        said = [max((x, -i) for i, x in enumerate(s)) for s in p if list(s) != [1, 1, 1]]
        return sum(-i for _, i in said) / 2 / len(said) if said else None

    # of equal likelihoods the plain maximum takes the lower genotype, the estimate the second of the first two
    fa, fb = start(a), start(b)
    if fa is None or fb is None:
        return None
    f = [(1 - fa) * (1 - fb), (1 - fa) * fb, fa * (1 - fb), fa * fb]
    for _ in range(50):
        new = [0.0] * 4
        for p, q in zip(a, b, strict=True):
            w = [[f[k] * f[h] * p[(k >> 1) + (h >> 1)] * q[(k & 1) + (h & 1)] for h in range(4)] for k in range(4)]
            total = sum(map(sum, w))
            for k in range(4):
                new[k] += sum(w[k]) / total / len(a)
        rest = max(abs(x - y) for x, y in zip(new, f, strict=True)) < 1e-5
        f = new
        if rest:
            break
    p, q = f[0] + f[1], f[0] + f[2]
    below = p * q * (1 - p) * (1 - q)
    return (f[0] * f[3] - f[1] * f[2]) ** 2 / below if below > 0 else None


def test_site_linkage(spark):
    rnd = random.Random(2)
    haplotypes = [(0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 0)]
    sites = {}
    for pos in range(0, 60, 3):
        weights = [rnd.random() for _ in haplotypes]
        sites["1", pos] = None
        gl = []
        for _ in range(12):
            g = sum(h[pos % 3] if rnd.random() < 0.8 else rnd.randrange(2) for h in rnd.choices(haplotypes, weights, k=2))
            gl.append([1.0, 1.0, 1.0] if rnd.random() < 0.1 else [rnd.uniform(0.5, 0.99) if k == g else rnd.uniform(0.001, 0.4) for k in range(3)])
        sites["1", pos] = gl
    sites["1", 61], sites["2", 1], sites["2", 2] = [[1.0] * 3] * 12, sites["1", 0], sites["1", 3][:5]
    df = spark.createDataFrame([(ch, pos, [x for s in gl for x in s]) for (ch, pos), gl in sites.items()] + [("2", 3, None), (None, 1, [])], "chrom string, pos long, gl array<double>")
    for window in (3, 7, 100):
        got = {(r.chrom, r.pos, r.other): r.r2 for r in likelihoods.site_linkage(df, window).collect()}
        keys = [*sites, ("2", 3)]
        assert got.keys() == {(x[0], x[1], y[1]) for x in keys for y in keys if x[0] == y[0] and 0 < y[1] - x[1] <= window}
        for (ch, x, y), r2 in got.items():
            a, b = sites.get((ch, x)), sites.get((ch, y))
            want = plain_linkage(a, b) if a and b and len(a) == len(b) else None
            assert r2 is None if want is None else r2 == pytest.approx(want, abs=1e-6)


def test_linkage_of_batches_equals_single_pairs():
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 9, 3)), rng.random((40, 9, 3))
    assert np.allclose(likelihoods.linkage(a, b), [likelihoods.linkage(a[i : i + 1], b[i : i + 1])[0] for i in range(40)], equal_nan=True)


def test_site_calls_equal_a_sum_over_all_genotypes(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(20):
        rows.append((k, [{"g0": rnd.random(), "g1": rnd.random() * 0.2, "g2": rnd.random() * 0.1} for _ in range(rnd.randint(1, 5))]))
    rows += [(90, []), (91, None), (92, [{"g0": 0.0, "g1": 0.0, "g2": 0.0}]), (93, [{"g0": 1.0, "g1": 1e-9, "g2": 1e-18}] * 100)]
    got = {r.k: r for r in likelihoods.site_calls(spark.createDataFrame(rows, "k int, gl array<struct<g0:double,g1:double,g2:double>>"), ["k"]).collect()}
    assert got.keys() == {*range(20), 92, 93} and got[92].p_variant is None and got[93].p_variant < 0.01 and got[93].best_count == 0
    for k, gl in rows[:20]:
        m = 2 * len(gl)
        like = [0.0] * (m + 1)
        for gs in itertools.product(range(3), repeat=len(gl)):
            like[sum(gs)] += math.prod(math.comb(2, g) * p[f"g{g}"] for g, p in zip(gs, gl, strict=True)) / math.comb(m, sum(gs))
        prior = [1 - sum(1e-3 / a for a in range(1, m + 1))] + [1e-3 / a for a in range(1, m + 1)]
        joint = [x * p for x, p in zip(like, prior, strict=True)]
        post = [x / sum(joint) for x in joint]
        assert got[k].p_variant == pytest.approx(1 - post[0], abs=1e-9) and got[k].qual == pytest.approx(-10 * math.log10(post[0]))
        assert got[k].mean_count == pytest.approx(sum(i * x for i, x in enumerate(post))) and got[k].best_count == post.index(max(post))


def test_nearest_pair_events_and_merged_stream(spark):
    rnd = random.Random(5)
    splits = [(rnd.choice("ab"), k, rnd.randint(0, 300)) for k in range(80)]
    pairs = []
    for k in range(60):
        at = rnd.randint(0, 300)
        pairs.append((rnd.choice("ab"), 1000 + k, at, at + rnd.randint(0, 5), at + rnd.choice([10, 60]), rnd.choice([0, 3, 15])))
    want = {}
    for family, i, pos in splits:
        near = [(min(abs(pos - a), abs(pos - b)), at > pos, abs(at - pos), p) for f, p, at, a, b, reach in pairs if f == family and min(abs(pos - a), abs(pos - b)) <= reach]
        if near:
            want[i] = (min(near)[3], min(near)[0])
    s = spark.createDataFrame(splits, "family string, split_id long, pos long")
    p = spark.createDataFrame(pairs, "family string, pair_id long, at long, pos3 long, pos5 long, reach long")
    for width in (7, 1000):
        found = callset.nearest_pair_events(s, p, width)
        assert {r.split_id: (r.pair_id, r.distance) for r in found.collect()} == want
    stream = sorted([(pos, f, True, i, want.get(i, (None,))[0]) for f, i, pos in splits] + [(at, f, False, i, i) for f, i, at, *_ in pairs if i not in {x for x, _ in want.values()}])
    got = callset.merged_events(s, p, found).orderBy("place").collect()
    assert [(r.place, r.family, r.pos, r.split_id, r.pair_id) for r in got] == [(k + 1, f, pos, i if split else None, pair) for k, (pos, f, split, i, pair) in enumerate(stream)]


def test_supported_and_unmasked_calls(spark):
    rnd = random.Random(6)
    calls = [(k, rnd.choice("xy"), p := rnd.randint(0, 400), p + rnd.randint(1, 3), rnd.choice(["AL", "L1", "SV", "PO"]), *(rnd.choice([0, 0, 1, 2, 5]) for _ in range(4)), rnd.choice([".:.", "0/0:1"])) for k in range(400)]
    masks = [(rnd.choice(["AL", "AL", "L1", "PO", "LOW"]), rnd.choice([0, 4]), rnd.choice("xy"), b := rnd.randint(0, 400), b + rnd.randint(1, 5)) for _ in range(40)]
    c = spark.createDataFrame(calls, "id int, chrom string, pos long, end long, family string, rp5 int, rp3 int, sr5 int, sr3 int, gt string")
    kept = {}
    for k, chrom, pos, end, family, r5, r3, s5, s3, gt in calls:
        if family != "PO" and (s5 >= 5 or s3 >= 5 or (r5 >= 2 and r3 >= 2) or ((r5 >= 2 or r3 >= 2) and (s5 or s3))):
            kept[k] = (chrom, pos, end, family, 2 if s5 or s3 else 1, gt)
    found = callset.supported_calls(c)
    assert {r.id: r.call_class for r in found.collect()} == {k: x[4] for k, x in kept.items()}
    assert {r.id for r in callset.supported_calls(c, first_genotype="gt").collect()} == {k for k, x in kept.items() if x[5] != ".:."}
    seen = {x[3] for x in kept.values()}
    off = {k for k, (chrom, pos, end, family, kind, _) in kept.items() if not any(m[2] == chrom and pos < m[4] + m[1] and end > m[3] - m[1] and (m[0] not in seen or (m[0] == family and kind == 1)) for m in masks)}
    m = spark.createDataFrame(masks, "type string, window int, chrom string, start long, stop long")
    for width in (8, 4096):
        assert {r.id for r in callset.unmasked_calls(found, m, "id", width).collect()} == off
    assert callset.unmasked_calls(found, m.filter(F.lit(False)), "id").count() == len(kept)


def plain_frequencies(p):
    """(frequency, genotype frequencies) of one site, sample by sample, as far as fifty rounds bring them."""
    f, g = 0.5, [1 / 3] * 3
    for _ in range(50):
        q = [(1 - f) ** 2, 2 * f * (1 - f), f * f]
        new = sum((x[1] * q[1] + 2 * x[2] * q[2]) / sum(a * b for a, b in zip(x, q, strict=True)) for x in p) / 2 / len(p)
        rest, f = abs(new - f) < 1e-5, new
        if rest:
            break
    for _ in range(50):
        new = [sum(x[k] * g[k] / sum(a * b for a, b in zip(x, g, strict=True)) for x in p) / len(p) for k in range(3)]
        rest, g = max(abs(a - b) for a, b in zip(new, g, strict=True)) < 1e-5, new
        if rest:
            break
    return f, g


def test_site_tests(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(30):
        rate, odd = rnd.random(), k % 3 == 0
        gl = []
        for i in range(14):
            high = min(1, rate + 0.6) if odd and i < 6 else rate
            g = rnd.choice([0, 2]) if k % 5 == 4 else (rnd.random() < high) + (rnd.random() < high)
            gl.append([1.0 if j == g else rnd.uniform(0.001, 0.1) for j in range(3)])
        rows.append((k, [x for s in gl for x in s]))
    df = spark.createDataFrame([*rows, (90, []), (91, None), (92, [0.0] * 3)], "k int, gl array<double>")
    got = {r.k: r for r in likelihoods.site_tests(df, ["k"], 6).collect()}
    assert all(got[k].frequency is None for k in (90, 91, 92))
    like = lambda p, q: sum(math.log(sum(a * b for a, b in zip(x, q, strict=True))) for x in p)
    mating = lambda f: [(1 - f) ** 2, 2 * f * (1 - f), f * f]
    # sites of one batch rest together, so a site may have gone a few rounds further than alone
    for k, flat in rows:
        p = [flat[i : i + 3] for i in range(0, 42, 3)]
        f, g = plain_frequencies(p)
        (f1, g1), (f2, g2) = plain_frequencies(p[:6]), plain_frequencies(p[6:])
        r = got[k]
        assert (r.frequency, r.frequency_1, r.frequency_2) == pytest.approx((f, f1, f2), abs=1e-3) and [r.g0, r.g1, r.g2] == pytest.approx(g, abs=1e-3)
        one = lambda x: math.erfc(math.sqrt(max(0, x)))
        assert r.hwe_p == pytest.approx(one(like(p, g) - like(p, mating(f))), abs=2e-3)
        assert r.allele_p == pytest.approx(one(like(p[:6], mating(f1)) + like(p[6:], mating(f2)) - like(p, mating(f))), abs=2e-3)
        assert r.genotype_p == pytest.approx(math.exp(-max(0, like(p[:6], g1) + like(p[6:], g2) - like(p, g))), abs=2e-3)
    assert min(r.hwe_p for k, r in got.items() if k % 5 == 4 and k < 90) < 0.01 and all(r.frequency_1 is None for r in likelihoods.site_tests(df, ["k"], 0).collect())


def test_counts_of_sites_reach_python_as_plain_numbers(spark):
    rows = [(1, "ACGT"[b], bool(s), q) for b in range(4) for s in (0, 1) for q in (5, 30, 61)] + [(2, "A", None, 20)] * 3
    found = likelihoods.base_likelihoods(spark.createDataFrame(rows, "site long, base string, reverse boolean, qual int"), ["site"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" in plan and "struct(" not in plan
    got = {r.site: list(r)[2:] for r in found.collect()}
    assert got[1] == likelihoods.likelihoods_of([(b, s, q, 1) for b in range(4) for s in (0, 1) for q in (5, 30, 61)])
    assert got[2] == likelihoods.likelihoods_of([(0, 0, 20, 3)])
