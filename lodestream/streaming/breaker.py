"""Circuit breaker per key, with a cooldown by the cause of a failure.

A key's requests come in order of time.  While its breaker is open a request is
skipped and changes nothing.  A success closes it and clears the count of
failures; a failure adds one and, from THRESHOLD on, opens the breaker for the
cooldown of its cause.  After the cooldown the count stands, so the next
failure opens it again at once.

As a batch this is a segmented scan.  Ranges of the ordered rows walk on their
own; what a range does to a breaker that comes into it is a small table, one
entry for each count of failures and one for each stretch of times until which
it may be open, and the tables are composed range by range.  So a key with a
third of all rows is walked by many tasks.  On a stream the same step runs in
keyed state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.operators.scan import segmented_scan

THRESHOLD = 2
#: Seconds a breaker stays open, and its state's name, by cause (fixed values).
COOLDOWN = {"captcha": 300.0, "rate": 60.0, "timeout": 15.0, "other": 30.0}
STATE = {"captcha": "CAPTCHA_BLOCKED", "rate": "RATE_LIMITED", "timeout": "DEGRADED", "other": "TEMPORARILY_UNAVAILABLE"}
HEALTHY = "HEALTHY"


def cause(reason: Column) -> Column:
    """captcha, rate, timeout or other, from a failure's reason (null: no failure)."""
    low = F.lower(reason)
    rate = low.contains("429") | low.contains("rate") | low.contains("too many requests")
    return F.when(reason.isNull(), None).when(low.contains("captcha"), "captcha").when(rate, "rate").when(low.contains("timeout"), "timeout").otherwise("other")


def state_name(failed: Column) -> Column:
    """The breaker's name after a request whose cause of failure is `failed` (null: a success)."""
    named = F.when(failed.isNull(), HEALTHY)
    for key, name in STATE.items():
        named = named.when(failed == key, name)
    return named


def step(failures: int, until: float, at: float, failed: str | None, cooldown: dict[str, float]) -> tuple[bool, int, float]:
    """(skipped, failures, open until) after one request; counts above THRESHOLD are alike."""
    if until > at:
        return True, failures, until
    if failed is None:
        return False, 0, 0.0
    failures = min(failures + 1, THRESHOLD)
    return False, failures, at + cooldown[failed] if failures >= THRESHOLD else 0.0


def effect(times: list[float], failed: list[str | None], cooldown: dict[str, float]) -> tuple[float, list, list, list]:
    """What a stretch of requests makes of an incoming breaker.

    The time of its first request; closed: the outcome (failures, open until)
    for each count of failures a closed breaker may come in with; bounds and
    outcomes: for a breaker open until t, the outcome for the first bound that
    is not below t; beyond the last one it stays open.  Requests that meet in
    one state go on alike, so they are walked from the end, once for each count.
    """
    n = len(times)
    ends: list[list[tuple[int, float]]] = [[]] * (n + 1)
    ends[n] = [(k, 0.0) for k in range(THRESHOLD + 1)]
    for i in reversed(range(n)):
        row = []
        for k in range(THRESHOLD + 1):
            _, failures, until = step(k, 0.0, times[i], failed[i], cooldown)
            if until <= times[i]:
                row.append(ends[i + 1][failures])
            else:  # open: the next request at or after its end finds it closed, with the count it had
                j = bisect_left(times, until, lo=i + 1)
                row.append(ends[j][failures] if j < n else (failures, until))
        ends[i] = row
    bounds: list[float] = []
    outcomes: list[tuple[int, float]] = []
    for i, at in enumerate(times):
        outcome = ends[i][THRESHOLD]
        if outcomes and outcomes[-1] == outcome:
            bounds[-1] = at
        elif not bounds or bounds[-1] < at:
            bounds.append(at)
            outcomes.append(outcome)
    return times[0], ends[0], bounds, outcomes


def through(state: tuple[int, float], table: tuple) -> tuple[int, float]:
    """The breaker after a stretch."""
    first, closed, bounds, outcomes = table
    failures, until = state
    if until <= first:
        return closed[failures]
    i = bisect_left(bounds, until)
    return outcomes[i] if i < len(bounds) else state


def walk(requests: DataFrame, by: str, order: list[str], at: Column, failed: Column, cooldown: dict[str, float] = COOLDOWN) -> DataFrame:
    """by, at, failed, the order columns, skipped, failures (up to THRESHOLD), open_until of every request.

    Requests of a key follow each other by `at` (seconds), then by the columns
    of order.  failed is a cause or null for a success.  Null keys are one key.
    """
    rows = requests.select(by, *order, at.cast("double").alias("at"), failed.alias("failed"))

    def one(state: tuple[int, float], t: float, c: str | None) -> tuple:
        skipped, n, until = step(*state, t, c, cooldown)
        return (n, until), skipped, n, until

    def of(stretch: list[tuple]) -> tuple:
        return effect([t for t, _ in stretch], [c for _, c in stretch], cooldown)

    return segmented_scan(rows, by, ["at", *order], ["at", "failed"], of, through, one, (0, 0.0), "skipped boolean, failures int, open_until double")


def openings(walked: DataFrame, by: str) -> DataFrame:
    """by, opened, open_until, cause, n_skipped, closed of each time a breaker opened: the failure that opened it, the requests it skipped, whether a later request found it closed."""
    own = walked.withColumn("opens", ~F.col("skipped") & F.col("failed").isNotNull() & (F.col("open_until") > F.col("at")))
    # open_until names an opening: the requests skipped by it carry it
    return own.filter("opens or skipped").groupBy(by, "open_until").agg(
        F.min(F.when(F.col("opens"), F.col("at"))).alias("opened"), F.min_by("failed", F.when(F.col("opens"), F.col("at"))).alias("cause"), F.sum(F.col("skipped").cast("long")).alias("n_skipped"),
    )


def walk_stream(requests: DataFrame, by: str, cooldown: dict[str, float] = COOLDOWN) -> DataFrame:
    """The same for a stream of (by, seq, at, failed): every request with the breaker after it; state is two numbers a key.

    Batches come in order of time; rows of one batch are put in order of at and seq.
    """
    kind = dict(requests.dtypes)[by]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = []
        for seq, t, c in zip(rows["seq"], rows["at"], rows["failed"]):
            skipped, *now = step(*now, t, c if isinstance(c, str) else None, cooldown)
            out.append((key[0], seq, skipped, *now))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[by, "seq", "skipped", "failures", "open_until"])

    return requests.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, seq long, skipped boolean, failures int, open_until double", "failures int, open_until double", "append", GroupStateTimeout.NoTimeout)
