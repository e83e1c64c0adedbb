"""Appending several tables as one batch, once: results of searches, and report files.

A batch's rows go to <base>/<table>/batch=<id>, and last a one-row commit
marker to <base>/_commits/batch=<id>.  Readers take committed batches only, so
a batch appears in all its tables at once or in none.  A batch that was
committed is not written again; one that broke off before its commit is
overwritten when it is tried again, as Structured Streaming does with the same
id.  One writer at a time has a given batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, base: str, batch: int) -> bool:
    return _exists(spark, f"{base}/{COMMITS}/batch={int(batch)}/_SUCCESS")


def append_once(tables: dict[str, DataFrame], base: str, batch: int) -> bool:
    """Append each table's rows as the batch, unless it is committed; whether it was written.

    A table without rows in this batch has an empty part.  Columns named batch
    are the sink's own and not allowed.
    """
    for name, rows in tables.items():
        if "batch" in rows.columns or name == COMMITS:
            raise ValueError(f"{name}: batch and {COMMITS} are names of the sink")
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, base, batch):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={int(batch)}")
    spark.range(1).select(F.lit(",".join(sorted(tables))).alias("tables")).coalesce(1).write.mode("overwrite").parquet(f"{base}/{COMMITS}/batch={int(batch)}")
    return True


def read_committed(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The rows of all committed batches, with their batch; parts without a commit are not read."""
    done = spark.read.parquet(f"{base}/{COMMITS}").select(F.col("batch").cast("long").alias("batch")).distinct()
    rows = spark.read.option("mergeSchema", "true").parquet(f"{base}/{table}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done, "batch", "left_semi").select(*[c for c in rows.columns if c != "batch"], "batch")


def stream_sink(split: Callable[[DataFrame], dict[str, DataFrame]], base: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each micro-batch, split into tables, is appended once under its id."""

    def sink(rows: DataFrame, batch: int) -> None:
        append_once(split(rows), base, batch)

    return sink


def session_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """A search's facts from its scored results (session, query, item_id, source, score, rank, at).

    sessions: one row a session; results: session, item_id, rank; scores:
    session, item_id, score; audit: what was recorded and when.
    """
    return {
        "sessions": rows.groupBy("session").agg(F.first("query").alias("query"), F.count(F.lit(1)).alias("n_results"), F.min("at").alias("started"), F.max("at").alias("finished")),
        "results": rows.select("session", "item_id", "source", "rank"),
        "scores": rows.select("session", "item_id", "score"),
        "audit": rows.groupBy("session").agg(F.lit("SEARCH_RECORDED").alias("event"), F.max("at").alias("at")),
    }


def write_report(metrics: DataFrame, path: str, title: str) -> None:
    """A report of a few rows as JSON lines and as a Markdown table, both overwritten."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in metrics.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = metrics.coalesce(1).select(F.concat(line).alias("value"))
    head = metrics.sparkSession.createDataFrame([(f"# {title}\n\n| {' | '.join(metrics.columns)} |\n|{' - |' * len(metrics.columns)}",)], "value string")
    head.coalesce(1).unionByName(body).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
