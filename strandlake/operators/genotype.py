"""Genotypes from evidence counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import binomial_log10

#: Chances of a reference read under the three genotypes, and the likelihood given without evidence.
REFERENCE_CHANCE, NAMES, NO_CALL = (0.999, 0.5, 0.001), ("0/0", "0/1", "1/1"), -0.48


def genotype(evidence: DataFrame) -> DataFrame:
    """Rows with n_ref and n_alt get gl_0 to gl_2 and gt; ties prefer the earlier genotype, no evidence is a no-call."""
    none = F.col("n_ref") + F.col("n_alt") == 0
    out = evidence
    for i, p in enumerate(REFERENCE_CHANCE):
        out = out.withColumn(f"gl_{i}", F.when(none, F.lit(NO_CALL)).otherwise(binomial_log10(p, F.col("n_ref"), F.col("n_alt"))))
    best = F.when((F.col("gl_0") >= F.col("gl_1")) & (F.col("gl_0") >= F.col("gl_2")), NAMES[0]).when(F.col("gl_1") >= F.col("gl_2"), NAMES[1]).otherwise(NAMES[2])
    return out.withColumn("gt", F.when(none, ".").otherwise(best))


def call_filter(calls: DataFrame, min_pairs: int = 2, min_splits: int = 5) -> DataFrame:
    """Calls kept by either kind of evidence or by both sides together, with their class."""
    rp5, rp3, sr5, sr3 = (F.col(c) for c in ("rp5", "rp3", "sr5", "sr3"))
    split, both = (sr5 >= min_splits) | (sr3 >= min_splits), (rp5 >= min_pairs) & (rp3 >= min_pairs)
    mixed = ((rp5 >= min_pairs) | (rp3 >= min_pairs)) & ((sr5 > 0) | (sr3 > 0))
    return calls.filter(split | both | mixed).withColumn("call_class", F.when((sr5 > 0) | (sr3 > 0), 2).otherwise(1))
