"""Population statistics over genotypes: allele counts and frequencies, and an exact test of 2 x 2 counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_counts(genotypes: DataFrame, site: str, gt: str) -> DataFrame:
    """(site, ac, an): alternative and called alleles; a genotype of `.` calls none."""
    alleles = lambda text: F.length(gt) - F.length(F.replace(F.col(gt), F.lit(text), F.lit("")))
    return genotypes.groupBy(site).agg(F.sum(alleles("1")).cast("long").alias("ac"), F.sum(alleles("0") + alleles("1")).cast("long").alias("an"))


def allele_frequency(likelihoods: Column, rounds: int = 20) -> Column:
    """The alternative allele's frequency by expectation maximization under random mating.

    likelihoods: an array with a struct (gl_0, gl_1, gl_2) of log10 likelihoods for each sample of a site, as call rows hold them;
    null if it is empty.
    """

    def alleles(gl: Column, f: Column) -> Column:
        top = F.greatest(gl["gl_0"], gl["gl_1"], gl["gl_2"])
        none, one, two = ((1 - f) * (1 - f) * F.pow(F.lit(10.0), gl["gl_0"] - top), 2 * f * (1 - f) * F.pow(F.lit(10.0), gl["gl_1"] - top), f * f * F.pow(F.lit(10.0), gl["gl_2"] - top))
        return (one + 2 * two) / (none + one + two)

    mean = lambda f: F.aggregate(likelihoods, F.lit(0.0), lambda s, gl: s + alleles(gl, f)) / (2 * F.size(likelihoods))
    return F.when(F.size(likelihoods) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.5), lambda f, _: mean(f)))


def exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table ((a, b), (c, d)) with its margins fixed: all tables no likelier than it.

    Chances fall from the likeliest table to both sides; each side is summed from its first table that counts outwards, until terms no longer matter,
    so neither time nor memory grows with the margins but with their square root.
    """
    n1, n2, m = a + b, c + d, a + c
    low, high = max(0, m - n2), min(n1, m)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log_p = lambda k: choose(n1, k) + choose(n2, m - k) - choose(n1 + n2, m)
    limit = log_p(a) + 1e-7
    mode = min(high, max(low, (n1 + 1) * (m + 1) // (n1 + n2 + 2)))
    if log_p(mode) <= limit:
        return 1.0

    def edge(inner: int, outer: int) -> int | None:
        """The table nearest to the likeliest one, from inner on towards outer, that counts."""
        if log_p(outer) > limit:
            return None
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (inner, middle) if log_p(middle) <= limit else (middle, outer)
        return outer

    def tail(k: int | None, step: int) -> float:
        if k is None:
            return 0.0
        term = total = math.exp(log_p(k))
        while low <= k + step <= high and term > total * 1e-18:
            term *= (n1 - k) * (m - k) / ((k + 1) * (n2 - m + k + 1)) if step > 0 else k * (n2 - m + k) / ((n1 - k + 1) * (m - k + 1))
            total += term
            k += step
        return total

    return min(1.0, tail(edge(mode, low), -1) + tail(edge(mode, high), 1))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """exact_p for each row; null where a count is."""

    def test(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        rows = zip(w, x, y, z, strict=True)
        return pd.Series([None if any(map(pd.isna, row)) else exact_p(*map(int, row)) for row in rows], dtype="float64")

    return F.pandas_udf(test, "double")(a, b, c, d)
