"""Lengths of unions and overlaps of intervals, by a sweep over their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.scan import segmented_scan


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """How much of an interval lies inside a window."""
    return F.greatest(F.lit(0).cast("long"), F.least(end, high) - F.greatest(start, low))


def depths(intervals: DataFrame, by: str) -> DataFrame:
    """by, at, prev, depth: the stretches between neighbouring ends of a key's intervals, and how many intervals cover each.

    intervals: by, start, end (long); empty and reversed ones are left out, as
    they cover nothing, and so are those with a null end.
    """
    some = intervals.filter(F.col("start") < F.col("end"))
    ends = some.select(by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("delta")))).alias("e")).select(by, "e.*")

    def effect(stretch: list[tuple]) -> tuple:
        return sum(d for _, d in stretch), stretch[-1][0]

    def through(state: tuple, table: tuple) -> tuple:
        return state[0] + table[0], table[1]

    def step(state: tuple, at: int, delta: int) -> tuple:
        depth, prev = state
        return (depth + delta, at), prev, depth

    return segmented_scan(ends, by, ["at", "delta"], ["at", "delta"], effect, through, step, (0, None), "prev long, depth long")


def overlap_accounts(intervals: DataFrame, windows: DataFrame, by: str) -> DataFrame:
    """by, n, total, union, shared (covered twice or more), deepest, overlap (with the key's window), hidden.

    windows: by, low, high, one row a key; hidden is what of the work's length
    went by inside the window: overlap, at most total.  A key without a window
    overlaps nothing.
    """
    swept = depths(intervals, by)
    length = F.col("at") - F.col("prev")
    lengths = swept.groupBy(by).agg(
        F.sum(F.when(F.col("depth") > 0, length).otherwise(0)).alias("union"), F.sum(F.when(F.col("depth") > 1, length).otherwise(0)).alias("shared"), F.max(F.col("depth") + F.greatest(F.col("delta"), F.lit(0))).alias("deepest"),
    )
    inside = F.coalesce(clipped(F.col("start"), F.col("end"), F.col("low"), F.col("high")), F.lit(0))
    own = intervals.filter(F.col("start") < F.col("end")).join(windows, by, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"), F.sum(inside).alias("overlap"))
    return own.join(lengths, by).select(by, "n", "total", "union", "shared", "deepest", "overlap", F.least("total", "overlap").alias("hidden"))
