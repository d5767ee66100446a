"""What the training-data operators share: table access and word rules; storage is the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.storage import broadcast_if_small, materialize, scratch_dir, scratch_path, small_batches

__all__ = ["WORD", "broadcast_if_small", "materialize", "scratch_dir", "scratch_path", "small_batches", "table"]

#: A word is a run of characters other than space and U+0009 to U+000D; bytes.split() follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, so that extra columns can't clash with an operator's own."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
