"""Batches that are appended once, and report files."""

import glob

import pytest
from pyspark.sql import functions as F

from lodestream.sources import sinks

ROWS = "session long, query string, item_id long, source string, score double, rank int, at long"


def facts(spark, sessions):
    return spark.createDataFrame([(s, f"q{s}", 10 * s + k, "abc"[k % 3], 1.0 / (k + 1), k + 1, 100 * s + k) for s in sessions for k in range(4)], ROWS)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "sink")
    assert sinks.append_once(sinks.session_tables(facts(spark, [1, 2])), base, 0)
    assert sinks.append_once(sinks.session_tables(facts(spark, [3])), base, 1)
    before = sorted(map(tuple, sinks.read_committed(spark, base, "results").collect()))
    assert not sinks.append_once(sinks.session_tables(facts(spark, [3, 4])), base, 1)
    assert sorted(map(tuple, sinks.read_committed(spark, base, "results").collect())) == before and len(before) == 12
    assert {r.session: r.n_results for r in sinks.read_committed(spark, base, "sessions").collect()} == {1: 4, 2: 4, 3: 4}
    with pytest.raises(ValueError):
        sinks.append_once({"x": facts(spark, [1]).withColumn("batch", F.lit(1))}, base, 2)


def test_a_batch_that_broke_off_is_not_read_and_is_written_whole_later(spark, tmp_path):
    base = str(tmp_path / "sink")
    sinks.append_once(sinks.session_tables(facts(spark, [1])), base, 0)

    def broken(rows):
        tables = sinks.session_tables(rows)
        bad = F.udf(lambda x: 1 // 0, "long")
        return {"results": tables["results"], "scores": tables["scores"].withColumn("item_id", bad("item_id"))}

    with pytest.raises(Exception):
        sinks.append_once(broken(facts(spark, [2])), base, 1)
    assert {r.session for r in sinks.read_committed(spark, base, "results").collect()} == {1}
    assert sinks.append_once(sinks.session_tables(facts(spark, [2])), base, 1)
    assert sorted(r.session for r in sinks.read_committed(spark, base, "results").collect()) == [1] * 4 + [2] * 4


def test_stream_batches_are_appended_once(spark, tmp_path):
    base = str(tmp_path / "sink")
    for k in range(3):
        facts(spark, [k]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = sinks.stream_sink(sinks.session_tables, base)

    def run(sink):
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    failed = []

    def breaks(rows, batch):
        sink(rows, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost after the commit, before the checkpoint")

    with pytest.raises(Exception):
        run(breaks)
    run(breaks)  # batch 1 comes again under its id
    assert sorted(r.session for r in sinks.read_committed(spark, base, "sessions").collect()) == [0, 1, 2]
    assert sinks.read_committed(spark, base, "audit").count() == 3 and failed == [1]


def test_report_files(spark, tmp_path):
    metrics = spark.createDataFrame([("p|5", 0.5), ("mrr", None)], "name string, value double")
    sinks.write_report(metrics, str(tmp_path / "r"), "Quality")
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/r/markdown/part-*"))
    assert text.startswith("# Quality\n\n| name | value |\n| - | - |\n") and "| p\\|5 | 0.5 |" in text and "| mrr |  |" in text
    assert spark.read.json(f"{tmp_path}/r/json").count() == 2
