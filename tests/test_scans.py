"""Segmented scans and what is built on them, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import intervals, scan, snapshots


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_of_hot_and_null_keys(spark, many_ranges):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", None]), k, r.randrange(9)) for k in range(900)]
    total = lambda state, v: (state + v, state + v)
    got = scan.segmented_scan(spark.createDataFrame(rows, "key string, n long, v int"), "key", ["n"], ["v"], lambda own: sum(x for (x,) in own), lambda state, t: state + t, total, 0, "sum long")
    assert got.rdd.getNumPartitions() > 1
    sums, want = {}, []
    for k, n, v in rows:
        sums[k] = sums.get(k, 0) + v
        want.append((n, k, v, sums[k]))
    assert sorted((g.n, g.key, g.v, g["sum"]) for g in got.collect()) == want
    assert scan.segmented_scan(spark.createDataFrame([], "key string, n long, v int"), "key", ["n"], ["v"], len, max, total, 0, "sum long").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slots_after_every_entry_equal_a_plain_log(spark, many_ranges, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, None]), v, r.choice([*snapshots.SLOTS, "ROLLBACK", "ROLLBACK", "odd", None])) for v in range(400)]
    states, want = {}, []
    for k, v, op in rows:
        s = states.setdefault(k, dict.fromkeys(snapshots.SLOTS))
        ok = op in snapshots.SLOTS
        if ok:
            s[op] = v
        elif op == "ROLLBACK" and s["VERIFIED_PRODUCTION"] is not None and s["PREVIOUS_PRODUCTION"] is not None:
            s["VERIFIED_PRODUCTION"], s["PREVIOUS_PRODUCTION"], ok = s["PREVIOUS_PRODUCTION"], s["VERIFIED_PRODUCTION"], True
        want.append((v, k, op, ok, *s.values()))
    found = snapshots.slots(spark.createDataFrame(rows, "tenant long, version long, op string"), "tenant", "version", "op")
    assert sorted((g.version, g.tenant, g.op, g.applied, g.production, g.previous, g.experimental, g.candidate) for g in found.collect()) == want
    at = {k: w[4:] for *_, w in [(w,) for w in want] for k in [w[1]] if w[0] <= 200}
    assert {g.tenant: tuple(g)[1:] for g in snapshots.as_of(found, "tenant", "version", 200).collect()} == at


def test_two_rollbacks_restore_the_slots(spark):
    log = [(1, 0, "VERIFIED_PRODUCTION"), (1, 1, "ROLLBACK"), (1, 2, "PREVIOUS_PRODUCTION"), (1, 3, "ROLLBACK"), (1, 4, "ROLLBACK")]
    got = sorted(map(tuple, snapshots.slots(spark.createDataFrame(log, "t long, v long, op string"), "t", "v", "op").select("v", "applied", "production", "previous").collect()))
    assert got == [(0, True, 0, None), (1, False, 0, None), (2, True, 0, 2), (3, True, 2, 0), (4, True, 0, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_accounts_equal_counting_by_unit(spark, many_ranges, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b"]), s := r.randrange(300), s + r.choice([-3, 0, 1, 7, 40])) for _ in range(200)] + [("c", 5, None)]
    windows = [("a", 50, 180), ("b", 1000, 1010)]
    got = {g.k: tuple(g)[1:] for g in intervals.overlap_accounts(spark.createDataFrame(rows, "k string, start long, end long"), spark.createDataFrame(windows, "k string, low long, high long"), "k").collect()}
    want = {}
    for key, (low, high) in (("a", windows[0][1:]), ("b", windows[1][1:])):
        own = [(s, e) for k, s, e in rows if k == key and e is not None and s < e]
        cover = [sum(s <= t < e for s, e in own) for t in range(400)]
        overlap = sum(max(0, min(e, high) - max(s, low)) for s, e in own)
        total = sum(e - s for s, e in own)
        want[key] = (len(own), total, sum(c > 0 for c in cover), sum(c > 1 for c in cover), max(cover), overlap, min(total, overlap))
    assert got == want
    none = spark.createDataFrame([], "k string, start long, end long")
    assert intervals.overlap_accounts(none, spark.createDataFrame(windows, "k string, low long, high long"), "k").count() == 0


def test_swept_stretches(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 21)], "k string, start long, end long")
    got = sorted((g["at"], g.prev, g.depth) for g in intervals.depths(rows, "k").collect())
    assert got == [(0, None, 0), (5, 0, 1), (10, 5, 2), (12, 10, 1), (20, 12, 0), (21, 20, 1)]
    assert rows.select(F.sum(intervals.clipped(F.col("start"), F.col("end"), F.lit(8), F.lit(20)))).first()[0] == 6
