"""Segmented scans: state carried along the ordered rows of each key, by ranges.

Rows are dealt by ranges of (key, order), so a key with a third of all rows is
walked by many tasks.  A first pass over the ranges says what each makes of an
incoming state, as a small table; the tables of keys that go on over a range's
end are composed one after another, two a range at most; a second pass walks
each range from the state it then knows.  Both passes read a written table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestream.sources.scratch import materialise

BATCH = 8192


def _numbered(ordered: DataFrame, names: list[str]) -> DataFrame:
    """part and place of each row in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), *batch.columns], ["part", "place", *names])
            place += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return materialise(ordered.mapInArrow(run, f"part int, place long, {fields}"), "ranges")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, BATCH).columns))


def segmented_scan(rows: DataFrame, by: str, order: list[str], values: list[str], effect: Callable, through: Callable, step: Callable, start, made: str) -> DataFrame:
    """by, order, values of every row, and the columns `made` that step gives for it.

    step(state, *values) gives (state, made values); effect(list of values)
    gives a table, small and picklable, of what a stretch of rows does, and
    through(state, table) the state after it.  order makes the rows of a key
    total, or leaves rows alike.  Null keys are one key.
    """
    names = list(dict.fromkeys([*order, *values]))
    rows = materialise(rows.select(F.col(by).alias("__key"), *names), "scanned")
    ordered = rows.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order)
    placed = _numbered(ordered, ["__key", *names]).repartition("part").sortWithinPartitions("part", "place")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(_rows(batches), key=lambda r: r[0]):
            # a range's first and last key may go on elsewhere; those between do not
            first = last = None
            for n, (key, stretch) in enumerate(groupby(own, key=lambda r: r[1])):
                last = {"part": part, "place": n, "key": pickle.dumps(key), "table": pickle.dumps(effect([r[2:] for r in stretch]))}
                first = first or last
            yield pa.RecordBatch.from_pylist([first] if first is last else [first, last], schema)

    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("key", pa.binary()), ("table", pa.binary())])
    tables = placed.select("part", "__key", *values).mapInArrow(summarise, "part int, place long, key binary, table binary")
    begins, key, state = {}, None, start
    for r in tables.orderBy("part", "place").collect():  # two rows a range
        if bytes(r.key) != key:
            key, state = bytes(r.key), start
        begins[r.part, key] = state
        state = through(state, pickle.loads(bytes(r.table)))

    schema_out = to_arrow_schema(StructType([*placed.select("__key", *names).schema.fields, *StructType.fromDDL(made).fields]))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, start
        at = [2 + names.index(v) for v in values]
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some, out = batch.slice(a, BATCH), []
                for row in zip(*(c.to_pylist() for c in some.columns)):
                    if row[:2] != here:
                        here = row[:2]
                        state = begins.get((row[0], pickle.dumps(row[1])), start)
                    state, *got = step(state, *(row[k] for k in at))
                    out.append(got)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema_out)[1 + len(names) :]))], schema=schema_out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select("__key", *names).schema.fields)
    return placed.select("part", "__key", *names).mapInArrow(replay, f"{fields}, {made}").withColumnRenamed("__key", by)
