"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream; event time as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type; state is dropped once the watermark passes a window."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def mates(events: DataFrame, name: str, first, second, wait: str = "1 hour") -> DataFrame:
    """First records (their columns with _1) with the second of their name at most wait apart; those without one come once it is late.

    The state of a name is dropped as soon as the watermark has passed what it could still meet.
    """
    own = [c for c in events.columns]
    left = events.filter(first).select(*[F.col(c).alias(f"{c}_1") for c in own]).withWatermark("ts_1", wait)
    right = events.filter(second).select(*[F.col(c).alias(f"{c}_2") for c in own]).withWatermark("ts_2", wait)
    near = F.col("ts_2").between(F.col("ts_1") - F.expr(f"INTERVAL {wait}"), F.col("ts_1") + F.expr(f"INTERVAL {wait}"))
    return left.join(right, (F.col(f"{name}_1") == F.col(f"{name}_2")) & near, "left_outer")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events with less than gap between: their begin, end and size."""
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key)
    return own.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def running_histogram(events: DataFrame, key: str, value) -> DataFrame:
    """Counts by key and value over all seen so far; for update or complete mode."""
    return events.groupBy(key, value.alias("value")).agg(F.count("*").alias("n"))


_RUN = "first timestamp, last timestamp, n long"


def _follow(key: str, column: str, wait_ms: int):
    """Runs of one value of a column within a key: the state holds the open run and is cleared as the value changes or the watermark passes its end."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, column, "first", "last", "n"]
        if state.hasTimedOut:
            done = [(name[0], *state.get)]
            state.remove()
            yield pd.DataFrame(done, columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        open_run, done = (state.get if state.exists else None), []
        for value, at in zip(rows[column], rows["ts"], strict=True):
            if open_run is not None and value == open_run[0]:
                open_run = (value, open_run[1], max(at, open_run[2]), open_run[3] + 1)
            else:
                if open_run is not None:
                    done.append((name[0], *open_run))
                open_run = (value, at, at, 1)
        state.update(open_run)
        end = int(pd.Timestamp(open_run[2]).timestamp() * 1000) + wait_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=columns)

    return step


def value_runs(events: DataFrame, key: str, column: str, late: str = "2 hours", wait_ms: int = 3_600_000) -> DataFrame:
    """(key, column, first, last, n): runs of events of a key that share a value, as a stream that arrives in order of event time within a key.

    A run comes once the value changes, or once the watermark is wait_ms behind its last event; its state, one row a key, goes with it. Events of one
    batch are put in order of time, those of later batches follow what was open.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    own = events.select(key, column, "ts").withWatermark("ts", late).groupBy(key)
    out = f"{key} {kinds[key]}, {column} {kinds[column]}, {_RUN}"
    return own.applyInPandasWithState(_follow(key, column, wait_ms), out, f"{column} {kinds[column]}, {_RUN}", "append", GroupStateTimeout.EventTimeTimeout)


def value_runs_batch(events: DataFrame, key: str, column: str) -> DataFrame:
    """What value_runs tells of a whole table in order of time."""
    order = Window.partitionBy(key).orderBy("ts")
    changed = events.withColumn("_new", F.when(F.col(column).eqNullSafe(F.lag(column).over(order)) & F.lag("ts").over(order).isNotNull(), 0).otherwise(1))
    run = changed.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run", column).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("_run")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all that is available, exactly once, into Parquet; gives the result as a batch."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
