"""Numbering rows in a global order, without a global window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.sources.scratch import materialise


def numbered(rows: DataFrame, order: list[str], tie: list[str], keep: list[str], weight: str | None = None) -> DataFrame:
    """The columns `keep` with index, 0 to n - 1 in the order of `order` and `tie` (nulls first), and rank, the index of the first row with equal `order`.

    Both depend on the rows alone, not on how they are dealt, as long as rows
    equal in order and tie are equal in keep.  rows must come from a written
    table.  `tie` may part rows with equal `order` over many tasks, so a value
    that a third of the rows share stays no task's burden.  One row for each
    range, its count and the keys at its ends, goes through the driver.

    weight: a column of positive numbers; index is then the sum of the weights
    before a row, and rank that before the first row with equal `order`.
    """
    size = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    null = [F.col(c).isNull() for c in order]
    sorted_ = rows.repartitionByRange(*order, *tie).sortWithinPartitions(*order, *tie).select(F.xxhash64(*order, *null).alias("__key"), size.alias("__size"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, first, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, ends = np.asarray(batch.column(0)), place + np.cumsum(np.asarray(batch.column(1)))
            at = np.concatenate([[place], ends[:-1]])
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            firsts = np.maximum.accumulate(np.where(new, at, first))
            place, first, last = ends[-1], firsts[-1], keys[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(at), pa.array(firsts), *batch.columns], ["__part", "__place", "__first", *batch.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    local = materialise(sorted_.mapInArrow(run, f"__part int, __place long, __first long, {fields}"), "numbered")
    offsets, before, begun, last = [], 0, 0, None
    for r in local.groupBy("__part").agg(F.max(F.col("__place") + F.col("__size")).alias("n"), F.min_by("__key", "__place").alias("low"), F.max_by("__key", "__place").alias("high"), F.max("__first").alias("last")).orderBy("__part").collect():
        begun = begun if r.low == last else before  # where the run that stands at this range's start begins
        offsets.append((r[0], before, begun))
        begun, last = begun if r.last == 0 else before + r.last, r.high
        before += r.n
    of = rows.sparkSession.createDataFrame(offsets, "__part int, __before long, __begun long")
    rank = F.when(F.col("__first") == 0, F.col("__begun")).otherwise(F.col("__before") + F.col("__first"))
    return local.join(F.broadcast(of), "__part").select(*keep, (F.col("__before") + F.col("__place")).alias("index"), rank.alias("rank"))


def running_sums(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """rows with running sums of doubles in each group, added one by one in the order of a column that is unique there.

    A sum of doubles depends on the order of its terms; that of a shuffle is
    not fixed, and thresholds and roundings that follow turn its last bit into
    another result.  The last running sum (see `last`) is fixed by the rows.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns(sums).withColumns({c: F.sum(c).over(w) for c in sums})


def last(column: str, order: str) -> Column:
    return F.max_by(column, order)
