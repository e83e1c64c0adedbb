"""Streams over files, held against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import breaker
from lodestream.streaming import streams as S


def write(spark, path):
    rows = [(j, s, e, float(s)) for j in range(5) for s, e in enumerate(["start", "collect", "completed" if j % 2 else "collect", "late"])]
    spark.createDataFrame(rows, "job_id long, sequence long, event string, amount double").write.parquet(path)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    e = spark.range(2000).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    e.write.parquet(f"{tmp_path}/in")
    stream = S.tumbling(S.read_events(spark, f"{tmp_path}/in"), "ts", "1 hour", "kind", late="10 minutes")
    out = S.drain(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    batch = S.tumbling(spark.read.parquet(f"{tmp_path}/in"), "ts", "1 hour", "kind")
    got, want = (sorted(map(tuple, d.collect())) for d in (out, batch))
    last = max(r[0] for r in want)
    assert [r for r in got if r[0] < last] == [r for r in want if r[0] < last], "all windows the watermark has passed"


def test_stateful_fold_equals_batch(spark, tmp_path):
    write(spark, f"{tmp_path}/in")
    seen = []
    query = S.event_state(S.read_events(spark, f"{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    state = {r.job_id: tuple(r) for r in seen}
    batch = {r.job_id: tuple(r) for r in S.event_state_batch(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert state == batch and batch[1][1:] == (3, "completed", 2, 3.0, True) and batch[0][2] == "late"


def test_fold_ignores_what_follows_a_terminal_event_and_repeats():
    s = S.fold(None, [(1, "b", 1.0), (0, "a", None)])
    assert s == (2, "b", 1, 1.0, False)
    s = S.fold(s, [(1, "b", 9.0), (2, "failed", 1.0), (3, "x", 1.0)])
    assert s == (3, "failed", 2, 2.0, True)


def test_breaker_and_history(spark):
    e = spark.createDataFrame([(0, k, k in (1, 2, 3, 5, 8, 9)) for k in range(10)], "u int, t int, bad boolean")
    got = S.breaker_intervals(e, "u", ["t"], F.col("bad"), F.col("t").cast("double"), threshold=2, cooldown=30.0)
    assert sorted(map(tuple, got.collect())) == [(0, 2, 8.0, 9.0, 39.0), (0, 3, 1.0, 3.0, 33.0)]
    jobs = spark.createDataFrame([(1, k) for k in range(10)], "job_id int, sequence int")
    assert sorted(r.sequence for r in S.recent(jobs, most=3).collect()) == [7, 8, 9]


def plain_breaker(rows, cooldown):
    """Each key's requests one after another: (key, seq) -> (skipped, failures, open until)."""
    out, state = {}, {}
    for k, seq, at, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        n, until = state.get(k, (0, 0.0))
        if until > at:
            out[k, seq] = (True, n, until)
            continue
        if failed is None:
            n, until = 0, 0.0
        else:
            n = min(2, n + 1)
            until = at + cooldown[failed] if n >= 2 else 0.0
        state[k] = (n, until)
        out[k, seq] = (False, n, until)
    return out


def requests(seed, n, keys, step, bad):
    r, at, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        at += r.choice([0.0, 1.0, step])
        rows.append((r.choice(keys), seq, at, r.choice(["captcha", "rate", "timeout", "other"]) if r.random() < bad else None))
    return rows


REQUEST = "k string, seq long, at double, failed string"


@pytest.mark.parametrize("seed,n,keys,step,bad,ranges", [(1, 400, ["a", "b", "c", None], 20.0, 0.6, 7), (2, 600, ["a"], 5.0, 0.9, 9), (3, 500, ["a", "b"], 90.0, 0.4, 5), (4, 60, ["a"], 1.0, 1.0, 30)])
def test_breaker_walks_as_a_plain_one(spark, seed, n, keys, step, bad, ranges):
    rows = requests(seed, n, keys, step, bad)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.k, r.seq): (r.skipped, r.failures, r.open_until) for r in breaker.walk(spark.createDataFrame(rows, REQUEST), "k", ["seq"], F.col("at"), F.col("failed")).select("k", "seq", "skipped", "failures", "open_until").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_breaker(rows, breaker.COOLDOWN)


def test_breaker_effects_compose(spark):
    for seed in range(60):
        rows = [r[2:] for r in requests(seed, 40, ["a"], 25.0, 0.7)]
        times, failed = [r[0] for r in rows], [r[1] for r in rows]
        table = breaker.effect(times, failed, breaker.COOLDOWN)
        for start in [(0, 0.0), (1, 0.0), (2, 0.0), *((2, t) for t in (0.5, times[3], times[9] + 0.1, times[-1], times[-1] + 7))]:
            state = start
            for t, c in rows:
                _, *state = breaker.step(*state, t, c, breaker.COOLDOWN)
            found = breaker.through(start, table)
            # an end that has passed means nothing any more
            clear = lambda s: (s[0], s[1] if s[1] > times[-1] else 0.0)
            assert clear(found) == clear(tuple(state))


def test_breaker_stream_equals_batch(spark, tmp_path):
    rows = requests(5, 90, ["a", "b"], 20.0, 0.6)
    spark.createDataFrame(rows, REQUEST).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = breaker.walk_stream(S.read_events(spark, f"{tmp_path}/in"), "k")
    out = S.drain(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert {(r.k, r.seq): (r.skipped, r.failures, r.open_until) for r in out.collect()} == plain_breaker(rows, breaker.COOLDOWN)


def test_breaker_edges(spark):
    none = spark.createDataFrame([], REQUEST)
    assert breaker.walk(none, "k", ["seq"], F.col("at"), F.col("failed")).count() == 0
    names = spark.createDataFrame([("Captcha wall",), ("HTTP 429",), ("Too Many Requests",), ("rate limit",), ("read TIMEOUT",), ("refused",), (None,)], "r string")
    assert [r[0] for r in names.select(breaker.cause(F.col("r"))).collect()] == ["captcha", "rate", "rate", "rate", "timeout", "other", None]
    opened = breaker.openings(breaker.walk(spark.createDataFrame([("a", k, float(k), "timeout" if k < 9 else None) for k in range(30)], REQUEST), "k", ["seq"], F.col("at"), F.col("failed")), "k")
    assert sorted((r.k, r.opened, r.open_until, r.cause, r.n_skipped) for r in opened.collect()) == [("a", 1.0, 16.0, "timeout", 14)]
