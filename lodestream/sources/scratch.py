"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside the innermost `temporary`, None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; set here only where the session names none and runs in one machine's process, as in tests.

    On a cluster a folder has to be named: a default could lie on one machine's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    Unlike a cache it survives lost executors, and unlike a plain re-use it is
    computed once.  Parquet keeps it columnar and compressed.  The table stays
    until the `temporary` block around the call ends; outside of one, whoever
    owns the folder clears it.

    by: a column with a folder for each value, so that a filter on it opens no
    other files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Drop what `materialise` makes inside the block; the block's own function makes tables that outlast it.

        with temporary(spark) as keep:
            found = keep(components(edges), "found")

    Kept tables belong to the block around this one, if there is one.
    """
    outer, own = _MADE.get(), []
    token = _MADE.set(own)

    def keep(df: DataFrame, what: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return materialise(df, what)
        finally:
            _MADE.reset(inner)

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in own:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
