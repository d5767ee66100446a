"""Likelihoods at sites: genotypes from bases whose errors depend on each other, linkage of neighbouring sites, and the spectrum of allele counts."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: How much of an error's weight each further base of its kind keeps, the least weight, the bounds of qualities, decibels of a natural logarithm.
DEPENDENCE, LEAST_WEIGHT, QUALITIES, DECIBEL = 0.83, 0.03, (4, 63), 4.343
PAIRS = [(j, k) for j in range(4) for k in range(j, 4)]
#: Rounds of expectation maximization, when it has come to rest, and the prior chance of a variant chromosome.
ROUNDS, REST, THETA = 50, 1e-5, 1e-3


@lru_cache(maxsize=4096)
def _surprise(n: int, quality: int) -> np.ndarray:
    """For k errors from 0 on among n bases: how surprising one more than k is once there are k, in decibels; infinite for n."""
    odds = 10 ** (-quality / 10) / (1 - 10 ** (-quality / 10))
    out, beyond = np.full(n + 1, np.inf), 0.0
    for k in range(n - 1, -1, -1):
        beyond = (n - k) / (k + 1) * odds * (1 + beyond)
        out[k] = -10 * math.log10(beyond / (1 + beyond))
    return out


def likelihoods_of(counts: list[tuple[int, int, int, int]]) -> list[float]:
    """Of (base, strand, quality, n) at a site, the ten genotypes' likelihoods in decibels below the best possible, in the order of PAIRS.

    Bases are taken by falling quality, then strand, then base. An error of a base weighs DEPENDENCE of the one before it on its strand, but
    LEAST_WEIGHT at least, and is as surprising as one more error of its base is after those before it.
    """
    n = sum(x[3] for x in counts)
    seen, weight, surprise = [0] * 4, {}, [0.0] * 4
    for quality, strand, base, times in sorted(((q, s, b, k) for b, s, q, k in counts), reverse=True):
        before = weight.get((strand, base), 0)
        weights = (1 - LEAST_WEIGHT) * DEPENDENCE ** np.arange(before, before + times, dtype=float) + LEAST_WEIGHT
        surprise[base] += float((weights * _surprise(n, max(QUALITIES[0], min(QUALITIES[1], quality)))[seen[base] : seen[base] + times]).sum())
        seen[base] += times
        weight[strand, base] = before + times
    out = []
    for j, k in PAIRS:
        others = sum(surprise[i] for i in range(4) if i not in (j, k) and seen[i])
        own = 0.0
        if j != k:
            both = seen[j] + seen[k]
            own = -DECIBEL * (math.lgamma(both + 1) - math.lgamma(seen[k] + 1) - math.lgamma(both - seen[k] + 1) - math.log(2) * both)
        out.append(max(0.0, own + others))
    return out


def base_likelihoods(bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, depth, gl_AA, gl_AC, ... gl_TT) of bases (keys, base A to T, reverse, qual): genotype likelihoods in decibels, 0 for the best possible.

    Equal bases are counted before they meet, so a site is at most 480 rows to its task, however deep it is; other letters, and bases without a quality,
    are left out. Counts reach Python as plain numbers, four a row: objects a row would take some hundred bytes each over a batch of sites.
    """
    code = F.position(c("base"), F.lit("ACGT")) - 1
    held = bases.filter(c("base").isin(*"ACGT") & c("qual").isNotNull()).select(*keys, code.alias("b"), F.coalesce(c("reverse"), F.lit(False)).cast("int").alias("s"), c("qual").cast("int").alias("q"))
    counted = held.groupBy(*keys, "b", "s", "q").agg(F.count("*").alias("n"))
    sites = counted.groupBy(*keys).agg(F.sum("n").alias("depth"), F.flatten(F.collect_list(F.array(*[c(x).cast("long") for x in "bsqn"]))).alias("counts"))

    def told(counts: pd.Series) -> pd.Series:
        return pd.Series([likelihoods_of([tuple(x) for x in site.reshape(-1, 4).tolist()]) for site in counts])

    gl = F.pandas_udf(told, "array<double>")("counts")
    return sites.withColumn("gl", gl).select(*keys, "depth", *[F.get("gl", F.lit(i)).alias(f"gl_{'ACGT'[j]}{'ACGT'[k]}") for i, (j, k) in enumerate(PAIRS)])


def _first_frequency(p: np.ndarray) -> np.ndarray:
    """The alternative allele's share among the likeliest genotypes of samples that say anything; nan without any."""
    said = (p != 1).any(axis=2)
    likeliest = np.where(p[:, :, 0] > p[:, :, 1], 0, 1)
    likeliest = np.where(np.take_along_axis(p, likeliest[:, :, None], 2)[:, :, 0] > p[:, :, 2], likeliest, 2)
    with np.errstate(invalid="ignore"):
        return (likeliest * said).sum(axis=1) / 2 / said.sum(axis=1)


def linkage(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """r squared of pairs of sites from genotype likelihoods (pairs, samples, 3), by expectation maximization over the four haplotypes; nan where one has no variant."""
    fa, fb = _first_frequency(a), _first_frequency(b)
    f = np.stack([(1 - fa) * (1 - fb), (1 - fa) * fb, fa * (1 - fb), fa * fb], axis=1)
    h = np.arange(4)
    joint = a[:, :, (h[:, None] >> 1) + (h >> 1)] * b[:, :, (h[:, None] & 1) + (h & 1)]  # of each two haplotypes, by their alleles at both sites
    live = np.flatnonzero(np.isfinite(f).all(axis=1))
    for _ in range(ROUNDS):
        if not len(live):
            break
        g, t = f[live], joint[live]
        each = np.einsum("pskh,ph->psk", t, g) * g[:, None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            new = (each / each.sum(axis=2, keepdims=True)).mean(axis=1)
        f[live] = new
        live = live[np.abs(new - g).max(axis=1) >= REST]
    p, q = f[:, 0] + f[:, 1], f[:, 0] + f[:, 2]
    with np.errstate(invalid="ignore", divide="ignore"):
        r2 = (f[:, 0] * f[:, 3] - f[:, 1] * f[:, 2]) ** 2 / (p * q * (1 - p) * (1 - q))
    return np.where(np.isfinite(r2), r2, np.nan)


def site_linkage(sites: DataFrame, window: int) -> DataFrame:
    """(chrom, pos, other, r2) of all pairs of sites (chrom, pos, gl) at most window places apart; gl holds three likelihoods a sample, samples in one order.

    Sites meet in tiles as wide as the window, so pairs beyond it are never made. r2 is null where a site has no variant or the two list
    different numbers of samples.
    """
    told = sites.filter(c("chrom").isNotNull() & c("pos").isNotNull())
    left = told.select("chrom", "pos", "gl", F.explode(F.sequence(F.floor(c("pos") / window), F.floor((c("pos") + window) / window))).alias("tile"))
    right = told.select("chrom", c("pos").alias("other"), c("gl").alias("other_gl"), F.floor(c("pos") / window).alias("tile"))
    met = left.join(right, ["chrom", "tile"]).filter((c("other") > c("pos")) & (c("other") <= c("pos") + window))

    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        sizes = [len(x) if x is not None and y is not None and len(x) == len(y) else 0 for x, y in zip(a, b, strict=True)]
        for n in set(sizes) - {0}:
            at = [i for i, s in enumerate(sizes) if s == n]
            for part in np.array_split(at, -(-len(at) * n * 16 // 3_000_000)):
                out[part] = linkage(*(np.stack([np.asarray(x.iloc[i], float) for i in part]).reshape(len(part), -1, 3) for x in (a, b)))
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return met.select("chrom", "pos", "other", F.pandas_udf(estimate, "double")("gl", "other_gl").alias("r2"))


def spectrum(gl: Column) -> Column:
    """How likely each number of variant chromosomes is, from 0 to all, up to a factor: a fold over the samples' likelihoods, an array of (g0, g1, g2).

    Each sample brings two chromosomes: the state spreads by none, one or two variant ones, every arrangement alike, and is scaled to a sum of 1.
    """
    size = lambda z: F.size(z)

    def step(z: Column, p: Column) -> Column:
        m = size(z) + 1  # chromosomes with this sample

        def one(k: Column) -> Column:
            at = lambda d: F.coalesce(F.when(k >= d, F.get(z, k - d)), F.lit(0.0))
            free = (m - k).cast("double")
            return free * (free - 1) * p["g0"] * at(0) + 2 * k * free * p["g1"] * at(1) + k * (k - 1) * p["g2"] * at(2)

        spread = F.transform(F.sequence(F.lit(0), m), one)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        return F.get(F.transform(F.array(spread), lambda xs: F.get(F.transform(F.array(total(xs)), lambda t: F.transform(xs, lambda x: F.when(t > 0, x / t).otherwise(0.0))), F.lit(0))), F.lit(0))

    return F.aggregate(gl, F.array(F.lit(1.0)), step)


def site_calls(sites: DataFrame, keys: list[str], theta: float = THETA) -> DataFrame:
    """(keys, p_variant, qual, mean_count, best_count) of sites (keys, gl): the posterior over the number of variant chromosomes, whose prior is theta / count.

    qual is the chance of no variant in decibels, 999 at most; all are null without samples or where nothing is likely.
    """
    m = F.size("z") - 1
    prior = F.transform(F.sequence(F.lit(0), m), lambda k: F.when(k > 0, theta / k))
    rest = F.aggregate(prior, F.lit(1.0), lambda s, x: s - F.coalesce(x, F.lit(0.0)))
    joint = F.zip_with(c("z"), c("prior"), lambda z, p: z * F.coalesce(p, c("rest")))
    total = F.aggregate("joint", F.lit(0.0), lambda s, x: s + x)
    found = sites.filter(F.size("gl") > 0).withColumn("z", spectrum(c("gl"))).withColumn("prior", prior).withColumn("rest", rest).withColumn("joint", joint).withColumn("total", total)
    some = c("total") > 0
    none = F.get("joint", F.lit(0)) / c("total")
    mean = F.aggregate(F.transform("joint", lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x) / c("total")
    best = F.array_position("joint", F.array_max("joint")) - 1
    told = {"p_variant": 1 - none, "qual": F.least(F.lit(999.0), F.when(none > 0, -10 * F.log10(none)).otherwise(999.0)), "mean_count": mean, "best_count": best}
    return found.select(*keys, *[F.when(some, x).alias(name) for name, x in told.items()])


def _allele_frequency(p: np.ndarray) -> np.ndarray:
    """The alternative allele's frequency of each site under random mating, by expectation maximization; p holds (sites, samples, 3)."""
    f = np.full(len(p), 0.5)
    dose = np.array([0.0, 1.0, 2.0])
    for _ in range(ROUNDS):
        w = p * _mating(f)[:, None, :]
        new = (w @ dose / w.sum(axis=2)).mean(axis=1) / 2
        rest = np.abs(new - f).max(initial=0) < REST
        f = new
        if rest:
            break
    return f


def _genotype_frequencies(p: np.ndarray) -> np.ndarray:
    """The three genotypes' frequencies of each site, free of any mating rule."""
    g = np.full((len(p), 3), 1 / 3)
    for _ in range(ROUNDS):
        w = p * g[:, None, :]
        new = (w / w.sum(axis=2, keepdims=True)).mean(axis=1)
        rest = np.abs(new - g).max(initial=0) < REST
        g = new
        if rest:
            break
    return g


def _mating(f: np.ndarray) -> np.ndarray:
    return np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], axis=1)


def _log_likelihood(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.log((p * g[:, None, :]).sum(axis=2)).sum(axis=1)


def _chance(ratio: float, degrees: int) -> float:
    """Of a likelihood ratio as large, by the chi-squared distribution of one or two degrees: both have a closed form."""
    x = max(0.0, 2 * ratio)
    return math.erfc(math.sqrt(x / 2)) if degrees == 1 else math.exp(-x / 2)


TESTS = "frequency double, g0 double, g1 double, g2 double, hwe_p double, frequency_1 double, frequency_2 double, allele_p double, genotype_p double"


def tests_of(p: np.ndarray, first: int) -> list[tuple]:
    """TESTS of each site from likelihoods (sites, samples, 3), the first so many samples being one group, the others the second; without two groups
    what compares them is None."""
    f, g = _allele_frequency(p), _genotype_frequencies(p)
    whole, free = _log_likelihood(p, _mating(f)), _log_likelihood(p, g)
    out = [[float(f[i]), *map(float, g[i]), _chance(free[i] - whole[i], 1), None, None, None, None] for i in range(len(p))]
    if 0 < first < p.shape[1]:
        parts = p[:, :first], p[:, first:]
        fs, gs = [_allele_frequency(x) for x in parts], [_genotype_frequencies(x) for x in parts]
        apart = sum(_log_likelihood(x, _mating(y)) for x, y in zip(parts, fs, strict=True))
        freely = sum(_log_likelihood(x, y) for x, y in zip(parts, gs, strict=True))
        for i, row in enumerate(out):
            row[5:] = [float(fs[0][i]), float(fs[1][i]), _chance(apart[i] - whole[i], 1), _chance(freely[i] - free[i], 2)]
    return [tuple(row) for row in out]


def site_tests(sites: DataFrame, keys: list[str], first: int) -> DataFrame:
    """(keys, TESTS): allele and genotype frequencies, whether genotypes fit random mating, and whether two groups of samples differ in alleles or genotypes.

    gl holds three likelihoods a sample, samples in one order. Sites without samples, or with one for which nothing is likely, have nulls.
    """

    def told(gl: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in TESTS.split(", ")]
        rows: list[tuple] = [(None,) * len(names)] * len(gl)
        own = [np.zeros((0, 3)) if x is None else np.asarray(x, float).reshape(-1, 3) for x in gl]
        sizes = [len(x) if len(x) and (x.sum(axis=1) > 0).all() else 0 for x in own]
        for n in set(sizes) - {0}:
            at = [i for i, s in enumerate(sizes) if s == n]
            for part in np.array_split(at, -(-len(at) * n // 300_000)):
                for i, row in zip(part, tests_of(np.stack([own[i] for i in part]), first), strict=True):
                    rows[i] = row
        return pd.DataFrame(rows, columns=names).astype("float64")

    found = sites.withColumn("t", F.pandas_udf(told, TESTS)("gl"))
    nan = lambda x: F.when(~F.isnan(x), x)
    return found.select(*keys, *[nan(c(f"t.{x.split()[0]}")).alias(x.split()[0]) for x in TESTS.split(", ")])
