"""The driver's tables read as alignments, intervals and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (
        F.lit(1) + F.when(F.col("l_linestatus") == "O", 16).otherwise(0) + F.when(F.col("l_returnflag") == "R", 1024).when(F.col("l_returnflag") == "A", 32).otherwise(0)
        + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("read_group"), (F.col("l_linenumber") % 5).alias("ref_id"), F.col("l_partkey").alias("pos"), F.floor("l_quantity").cast("int").alias("frag_len"),
        F.round(F.col("l_discount") * 100).cast("int").alias("map_qual"), flag.alias("flag"), F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("line"),
    )


ALIGNMENTS = """SELECT l_suppkey AS read_group, l_linenumber % 5 AS ref_id, l_partkey AS pos, CAST(floor(l_quantity) AS INT) AS frag_len, CAST(round(l_discount * 100) AS INT) AS map_qual,
  1 + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1024 WHEN l_returnflag = 'A' THEN 32 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END AS flag,
  l_orderkey AS name, l_linenumber AS line FROM lineitem"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("family"), F.col("user_id").alias("sample_id"), at.alias("start_us"), (at + F.round(F.col("value") * 1000000).cast("long")).alias("end_us"))


INTERVALS = "SELECT event_id, event_type AS family, user_id AS sample_id, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us FROM events"


def bases(text: Column) -> Column:
    """A text's letters dealt over A, C, G and T."""
    return F.regexp_replace(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bases(F.col("text")).alias("seq"))


SEQUENCES = "SELECT doc_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq FROM documents"


#: Columns of read pairs over lineitem, in SQL that both engines read alike.
PAIR_COLUMNS = {
    "name": "l_orderkey",
    "line": "l_linenumber",
    "read_group": "l_suppkey",
    "ref_id": "l_linenumber % 5 - CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END",
    "mate_ref": "CASE WHEN l_suppkey % 4 = 0 THEN (l_linenumber + 1) % 5 ELSE l_linenumber % 5 END",
    "pos": "l_partkey",
    "mate_pos": "l_partkey + CAST(floor(l_quantity) AS INT) - 25",
    "frag_len": "CAST(floor(l_quantity) AS INT)",
    "insert_size": "CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END * CAST(floor(l_quantity) AS INT)",
    "map_qual": "CAST(round(l_discount * 100) AS INT)",
    "mate_qual": "CAST(round(l_tax * 100) AS INT)",
    "flag": "1 + CASE WHEN l_suppkey % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 11 = 0 THEN 8 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 32 ELSE 0 END"
    " + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 13 = 0 THEN 512 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END",
    "code": "CASE WHEN l_suppkey % 5 = 0 THEN 'AL' WHEN l_suppkey % 5 = 1 THEN 'L1' END",
    "mate_code": "CASE WHEN l_partkey % 6 = 0 THEN 'AL' WHEN l_partkey % 6 = 1 THEN 'SV' END",
    "lead_clip": "l_linenumber % 4 * 3",
    "trail_clip": "CASE WHEN l_returnflag = 'N' THEN 8 ELSE 0 END",
    "n_del": "CAST(round(l_tax * 100) AS INT) % 3",
}
PAIRS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PAIR_COLUMNS.items()) + " FROM lineitem"
#: A CIGAR of clips, matches, a deletion and an insertion; parts of length 0 are left out.
_part = lambda n, op: f"CASE WHEN {n} > 0 THEN CAST({n} AS STRING) || '{op}' ELSE '' END"
CIGAR = f"{_part('lead_clip', 'S')} || CAST(frag_len AS STRING) || 'M' || {_part('n_del', 'D')} || '2I7M' || {_part('trail_clip', 'S')}"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PAIR_COLUMNS.items()]).withColumn("cigar", F.expr(CIGAR))
