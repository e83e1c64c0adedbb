"""Stream operators and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

TERMINAL = ["completed", "failed", "cancelled"]
HISTORY = 64


def tumbling(events: DataFrame, at: str, step: str, by: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window; on a stream with `late` as its watermark."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(F.window(at, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table, and read it."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def breaker_intervals(events: DataFrame, by: str, order: list[str], failed: Column, at: Column, threshold: int = 2, cooldown: float = 60.0) -> DataFrame:
    """Stretches of consecutive failures per key that open a breaker: first and last failure, count, open until.

    Gaps and islands: the running count of successes numbers the stretches.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.withColumn("failed", failed.cast("int")).withColumn("island", F.sum(1 - F.col("failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("at_seconds", at)
    runs = rows.filter("failed = 1").groupBy(by, "island").agg(F.count(F.lit(1)).alias("failures"), F.min("at_seconds").alias("first"), F.max("at_seconds").alias("last"))
    return runs.filter(F.col("failures") >= threshold).select(by, "failures", "first", "last", (F.col("last") + cooldown).alias("open_until"))


STATE = "n_events long, phase string, last_sequence long, total double, ended boolean"


def fold(state: tuple | None, rows: list[tuple]) -> tuple:
    """Apply (sequence, event, amount) in order; nothing changes after a terminal event."""
    n, phase, last, total, ended = state or (0, "idle", -1, 0.0, False)
    for sequence, event, amount in sorted(rows, key=lambda r: r[0]):
        if ended or sequence <= last:
            continue
        n, phase, last, total = n + 1, event, sequence, total + (amount or 0.0)
        ended = event in TERMINAL
    return n, phase, last, total, ended


def event_state(events: DataFrame, job: str = "job_id", forget_after_ms: int | None = None) -> DataFrame:
    """Streaming state per job, from rows (job, sequence, event, amount).

    With forget_after_ms the state of ended jobs goes that long after they
    ended.  Streams with such a timer always have another batch to run, so it is
    for continuous triggers: a query with availableNow would not end.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else None
        for pdf in batches:
            now = fold(now, list(zip(pdf["sequence"], pdf["event"], pdf["amount"])))
        state.update(now)
        if now[4] and forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame([(key[0], *now)], columns=[job, "n_events", "phase", "last_sequence", "total", "ended"])

    kind = dict(events.dtypes)[job]
    timer = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(job).applyInPandasWithState(update, f"{job} {kind}, {STATE}", STATE, "update", timer)


def event_state_batch(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The same states of a bounded table, by windows and one aggregation."""
    w = Window.partitionBy(job).orderBy("sequence")
    rows = events.withColumn("ended_before", F.coalesce(F.max(F.col("event").isin(TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.filter("ended_before = 0")
    return rows.groupBy(job).agg(
        F.count(F.lit(1)).alias("n_events"), F.max_by("event", "sequence").alias("phase"), F.max("sequence").alias("last_sequence"),
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("total"), F.max(F.col("event").isin(TERMINAL)).alias("ended"),
    )


def recent(events: DataFrame, job: str = "job_id", most: int = HISTORY) -> DataFrame:
    """The last events of each job: a bounded history."""
    w = Window.partitionBy(job).orderBy(F.col("sequence").desc())
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= most)
