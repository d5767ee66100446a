"""Tables stored in the cluster's shared folder, and broadcasts of a measured size."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast up to so many bytes of values, measured; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20
#: Texts reach Python in batches of so many bytes; Spark's own limit of 64 MB is held several times over by each worker of an executor.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Cells of alignments that make a task, and rows that a task sorts.
WORK, SORTED_ROWS = 1 << 25, 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session that names none (tests) gets one of its own; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Python's batches are bounded by BATCH_BYTES from now on, unless the session has a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, BATCH_BYTES)
    return df


def dealt_by_work(df: DataFrame, work: float | None) -> DataFrame:
    """df in partitions of about WORK each, of so much work in all: few bytes can be hours of work, and partitions joined by size would make them one task."""
    return df.repartition(max(1, math.ceil((work or 0) / WORK)))


def dealt_for_sorting(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by keys into as many partitions as Spark is set to use, and more where rows in all would give each more than SORTED_ROWS: what a task
    sorts doesn't grow with the table, unless one key does."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SORTED_ROWS)), *keys)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: 8 for a number, its length for a text, the sum of its parts for a nested one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda s, x: s + value_bytes(x, kind.elementType)), F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A broadcast hint where the values of df, measured in one pass, stay within limit bytes. df should be stored: it is read again."""
    total = df.agg(F.sum(sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= (BROADCAST_BYTES if limit is None else limit) else df
