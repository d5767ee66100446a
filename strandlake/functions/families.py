"""Calls of related samples from the likelihoods of ten genotypes, in decibels below the best possible; trios are called in Arrow batches, the rest is built-in expressions."""

from __future__ import annotations

from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten genotypes in their order.
GENOTYPES = ["".join(x) for x in combinations_with_replacement("ACGT", 2)]
#: Trios whose costs are held at once.
_AT_ONCE = 1 << 9


def trios(on_x: bool = False, son: bool = False) -> list[tuple[int, int, int]]:
    """(child, father, mother) as places in GENOTYPES that inheritance allows. On X the father has one allele and a son's comes from his mother alone."""
    alleles = [set(g) for g in GENOTYPES]
    found = []
    for f, m, k in product(range(10), repeat=3):
        father, mother, child = alleles[f], alleles[m], alleles[k]
        if on_x and len(father) > 1:
            continue
        if on_x and son:
            fits = len(child) == 1 and bool(mother & child)
        else:
            fits = bool(father & child) and bool(mother & child) and child <= father | mother
        if fits:
            found.append((k, f, m))
    return found


def trio_call(child: Column, father: Column, mother: Column, on_x: bool = False, son: bool = False) -> Column:
    """(llr, child, father, mother, free): what the best inherited genotypes cost beyond the best ones each by itself, which free names; of equal ones the
    first by mother, father and child. A large llr speaks for a new mutation."""
    # sorted, so that the first of equal costs is the one wanted
    table = np.array(sorted(trios(on_x, son), key=lambda x: (x[2], x[1], x[0])))
    whole = [F.when(F.size(gl) == len(GENOTYPES), gl).cast("array<double>") for gl in (child, father, mother)]

    def costs(gl: pa.Array) -> np.ndarray:
        return pc.list_flatten(gl).to_numpy(zero_copy_only=False).reshape(-1, len(GENOTYPES))

    def best(c: pa.Array, f: pa.Array, m: pa.Array) -> pa.Array:
        given = pc.and_(pc.and_(c.is_valid(), f.is_valid()), m.is_valid())
        at, (kid, dad, mum) = np.flatnonzero(given), (costs(x.filter(given)) for x in (c, f, m))
        place, known = np.zeros(len(given), np.int64), np.zeros(len(given), bool)
        known[at] = ~np.isnan(kid + dad + mum).any(axis=1)
        for low in range(0, len(at), _AT_ONCE):
            part = slice(low, low + _AT_ONCE)
            place[at[part]] = (kid[part][:, table[:, 0]] + dad[part][:, table[:, 1]] + mum[part][:, table[:, 2]]).argmin(axis=1)
        return pa.array(place, pa.int32(), mask=~known)

    chosen = F.get(F.lit(table.tolist()).cast("array<array<int>>"), F.arrow_udf(best, "int")(*whole))
    names = F.lit(GENOTYPES)
    free = F.concat_ws(",", *[F.get(names, (F.array_position(gl, F.array_min(gl)) - 1).cast("int")) for gl in (child, father, mother)])

    def told(t: Column) -> Column:
        cost = sum((F.get(gl, F.get(t, F.lit(k))) - F.array_min(gl) for k, gl in enumerate((child, father, mother))), F.lit(0))
        return F.struct(cost.alias("llr"), *[F.get(names, F.get(t, F.lit(k))).alias(who) for k, who in enumerate(("child", "father", "mother"))], free.alias("free"))

    return F.get(F.transform(F.array(chosen), told), F.lit(0))


def pair_call(a: Column, b: Column) -> Column:
    """What one genotype for both samples costs beyond the best one of each."""
    return F.array_min(F.zip_with(a, b, lambda x, y: x + y)) - F.array_min(a) - F.array_min(b)


def least_difference(samples: Column) -> Column:
    """Over an array of samples' likelihoods, the least gap between a sample's best and second-best genotype."""
    # sort_array compares numbers themselves, array_sort calls a function for each two
    gap = lambda gl: F.get(F.transform(F.array(F.sort_array(F.array_compact(gl))), lambda x: F.get(x, F.lit(1)) - F.get(x, F.lit(0))), F.lit(0))
    return F.array_min(F.transform(samples, gap))
