"""The registry of jobs: its rules, its stream with timers, and the batch twin."""

import random

from pyspark.sql import functions as F

from lodestream.streaming import registry

KINDS = "registry string, job string, event string, at double, seq long"


def plain(rows, ttl, capacity, until):
    out, state = [], {}
    for name, job, event, at, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        jobs = state.setdefault(name, {})
        for k in sorted(jobs, key=lambda k: (jobs[k][2] or 0, k)):
            if jobs[k][2] is not None and jobs[k][2] <= at:
                out.append((name, k, "expired", jobs.pop(k)[2]))
        if event == "start" and job not in jobs:
            if len(jobs) >= capacity:
                done = [k for k, v in jobs.items() if v[1] is not None]
                if not done:
                    out.append((name, job, "refused", at))
                    continue
                oldest = min(done, key=lambda k: (jobs[k][0], k))
                del jobs[oldest]
                out.append((name, oldest, "evicted", at))
            jobs[job] = [at, None, None]
            out.append((name, job, "admitted", at))
        elif event in ("completed", "failed", "cancelled") and job in jobs and jobs[job][1] is None:
            jobs[job][1:] = [at, max(at, jobs[job][0] + ttl)]
            out.append((name, job, "ended", at))
    for name, jobs in state.items():
        out += [(name, k, "expired", v[2]) for k, v in jobs.items() if v[2] is not None and v[2] <= until]
    return sorted(out)


def events(seed, n, gap=1.0):
    r, at, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        at += r.choice([0.0, gap, 5 * gap])
        rows.append((r.choice(["a", "a", "b"]), f"j{r.randrange(12)}", r.choice(["start", "start", "collect", "completed", "failed"]), at, seq))
    return rows


def test_changes_equal_plain_rules(spark):
    seen = set()
    for seed, ttl in ((0, 30.0), (1, 200.0), (2, 0.0)):
        rows = events(seed, 300)
        got = registry.changes(spark.createDataFrame(rows, KINDS).repartition(4), ttl=ttl, capacity=3, until=400.0)
        want = plain(rows, ttl, 3, 400.0)
        assert sorted(map(tuple, got.collect())) == want
        seen |= {w[2] for w in want}
    assert seen == set(registry.CHANGES)
    assert registry.changes(spark.createDataFrame([], KINDS)).count() == 0


def test_timers_run_and_the_stream_equals_the_batch(spark, tmp_path):
    rows = events(7, 60)
    last = rows[-1][3]
    rows += [("d", "late", "start", last, 60), ("d", "late", "failed", last, 61)]
    flush = [(name, "none", "collect", last + t, 1000 + k) for k, (name, t) in enumerate([("c", 500.0), ("c", 1000.0)])]
    stamped = F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("time")
    for part in (rows[:30], rows[30:], flush[:1], flush[1:]):
        spark.createDataFrame(part, KINDS).select("registry", "job", "event", "seq", stamped).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = registry.stream_changes(stream, ttl=30.0, capacity=3).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == plain(rows, 30.0, 3, last + 500.0)
    assert sum(g[2] == "expired" and g[3] > last for g in got) > 0, "some were forgotten by a timer alone"
