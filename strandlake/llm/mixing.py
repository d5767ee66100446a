"""Operator 4, mixing sources to target weights, in DataFrame functions alone.

Sizes are summed per source, targets follow from the weights by filling the least bounded sources first, and a document
is emitted floor(rate) times plus once more if its hash-seeded draw falls below the fraction.

Defined cases: a null text has size 0; null sources are one source, the last; a source of size 0 has target 0; a null
doc_id draws by its text; equal rows draw alike; no table, no rows; other columns are carried along and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Weights in turn over the sources, the mix's share of all sizes in percent, the bound in sizes.
WEIGHTS, SHARE_PERCENT, BOUND = (5, 2, 1), 150, 2
SEED = "mix-1"
#: Sources are broadcast up to so many bytes of names, checked; beyond, the join is shuffled with salted sources.
BROADCAST_BYTES, SALTS = 8_000_000, 32


def text_size(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size), one row each, to these and target.

    The level L with sum(min(BOUND * size, L * weight)) = share is found in closed form: sources in the order of
    BOUND * size / weight are full from the first on; the rest share what is left. Sums are of whole numbers.
    A single task sees the sources, one short row each, never documents.
    """
    k = len(WEIGHTS)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % k
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", weight).withColumn("cap", BOUND * F.col("source_size"))
    unit = 1
    for w in WEIGHTS:
        unit *= w
    s = s.withColumn("fill", F.expr(f"cap * ({unit} div w)"))  # cap / w in whole numbers
    up = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("taken_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("level", (SHARE_PERCENT * F.col("all_size") - 100 * F.col("full")).cast("double") / (100 * (F.col("all_w") - F.col("taken_w"))).cast("double"))
    s = s.withColumn("open", F.col("cap").cast("double") > F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct("fill", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    s = s.withColumn("first_open", level)
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("first_open") * F.col("w")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def draw(seed: str, doc_id: F.Column, text: F.Column) -> F.Column:
    """A number in [0, 1) from the row's own values: 52 bits of an MD5."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def plan_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc, size, source_size, target, copies): doc is the row of docs as a struct, copies how often the mix holds it."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("source"), text_size().alias("size"))
    sizes = docs.select("source", text_size().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes), "mix-targets")
    named = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("key"), "source_size", "target")
    rows = rows.withColumn("key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    if (targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(named), "key")
    else:
        salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw(seed, F.col("doc.doc_id"), F.col("doc.text")) < rate - whole).cast("long")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as planned."""
    planned = plan_mix(docs, seed).filter("copies > 0")
    return planned.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle_parts(docs: str) -> str:
    """DuckDB's common table expressions up to planned(doc_id, ..., size, source_size, target, copies) over a relation."""
    return rf"""
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap FROM sources),
ordered AS (
  SELECT *, cap * (10 // w) AS fill, coalesce(sum(cap) OVER before, 0) AS full_caps, coalesce(sum(w) OVER before, 0) AS full_w, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
  FROM weighted WINDOW before AS (ORDER BY cap * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (150 * all_size - 100 * full_caps)::DOUBLE / (100 * (all_w - full_w))::DOUBLE AS level FROM ordered),
first_open AS (SELECT level FROM levels WHERE cap::DOUBLE > level * w ORDER BY fill, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM first_open) * w), cap::DOUBLE) AS target FROM weighted),
rates AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
planned AS (
  SELECT *, floor(rate)::BIGINT + (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::BIGINT AS copies
  FROM rates)"""


ORACLE_SQL = f"WITH {oracle_parts('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM planned"
