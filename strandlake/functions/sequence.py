"""Functions over nucleotide text: columns are built-in expressions, so they stay inside code generation; the k-mers of whole tables are cut in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: Places of a batch's joined texts whose k-mers are held at once.
WINDOW = 1 << 19


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def sequence_md5(seq: Column) -> Column:
    """Upper-case digest of the upper-cased sequence, as alignment headers carry it."""
    return F.upper(F.md5(F.upper(seq)))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits over A, C, G and T; other letters don't count; 0 without any."""
    counts = [base_count(seq, b).cast("double") for b in BASES]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.coalesce(parts[0] + parts[1] + parts[2] + parts[3], F.lit(0.0))


def kmers(seq: Column, k: int) -> Column:
    """(position from 0, k-mer) for every k-mer of A, C, G and T alone, for short texts: each is found from the text's beginning, so work grows with the
    square of the length. `kmer_rows` and `kmer_counts` take any."""
    last = F.length(seq) - k
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.substr(seq, i + 1, F.lit(k)).alias("kmer")))
    kept = F.filter(made, lambda x: x["kmer"].rlike("^[ACGT]+$"))
    return F.when(last >= 0, kept).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def two_bit_key(kmer: Column) -> Column:
    """A k-mer as a number of two bits a base, A lowest, the first base highest; null with other letters or beyond 31 bases."""
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[np.frombuffer(BASES.encode(), np.uint8)] = range(4)


def _windows(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, position, two_bit_key) of the k-mers of texts, a window of their joined letters at a time."""
    joined = _DIGITS[np.frombuffer("-".join(x or "" for x in texts).encode("ascii", "replace"), np.uint8)]
    starts = np.cumsum([0, *(len(x or "") + 1 for x in texts)])
    for low in range(0, len(joined) - k + 1, WINDOW):
        part = joined[low : low + WINDOW + k - 1]
        n = len(part) - k + 1
        wrong = np.concatenate([[0], np.cumsum(part > 3)])
        at = np.flatnonzero(wrong[k:] == wrong[:-k])
        keys = np.zeros(n, np.int64)
        for j in range(k):
            keys = keys << 2 | part[j : j + n]
        text = np.searchsorted(starts, at + low, "right") - 1
        yield text, (at + low - starts[text]).astype(np.int32), keys[at]


def kmer_rows(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """The other columns of rows with `pos`, from 0, and `kmer`, its two_bit_key, for every k-mer of A, C, G and T alone of seq; k is 31 at most.

    Work grows with the texts' length; a task holds a batch's texts and one window of k-mers.
    """
    kept = [x for x in rows.columns if x != seq]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, pos, key in _windows(batch.column(0).to_pylist(), k):
                own = [x.take(pa.array(text)) for x in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pos), pa.array(key)], names=[*kept, "pos", "kmer"])

    schema = T.StructType([*(rows.schema[x] for x in kept), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.LongType())])
    return rows.select(seq, *kept).mapInArrow(cut, schema)


def kmer_counts(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, n): how often each two_bit_key occurs in seq over all rows; each window is counted before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, key in _windows(batch.column(0).to_pylist(), k):
                n = np.bincount(key) if 4**k <= WINDOW else None
                found, n = (np.flatnonzero(n), n[n > 0]) if n is not None else np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    return rows.select(seq).mapInArrow(count, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def family_name(name: Column) -> Column:
    """The text between the first underscore and the next full stop; null if there is no underscore."""
    found = F.regexp_extract(name, r"^[^_]*_([^.]*)", 1)
    return F.when(F.instr(name, "_") > 0, found)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def log10_factorial(n: Column) -> Column:
    """Exact up to 20, beyond that by Stirling's series, whose error is below 1e-11 there."""
    import math

    x = F.greatest(n, F.lit(21)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log10(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series / math.log(10))


def log10_choose(n: Column, k: Column) -> Column:
    """log10 of n over k, in the same time for any counts."""
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def binomial_log10(p: float, ref: Column, alt: Column) -> Column:
    import math

    return log10_choose(ref + alt, alt) + ref * math.log10(p) + alt * math.log10(1 - p)
