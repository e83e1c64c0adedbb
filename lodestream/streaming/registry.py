"""A bounded registry of jobs, with expiry, in keyed streaming state.

Rows (registry, job, event, at) come in order of time.  `start` admits a job: a
full registry first gives up its oldest job that has ended, and refuses the new
one if none has.  A terminal event ends a job; an ended job is forgotten TTL
seconds after it was admitted, or as soon as it has ended if that is later.
Every change is one output row (registry, job, change, at), change being one of
CHANGES.

On a stream the jobs of a registry are map state, and forgetting is a timer on
event time.  `changes` is the batch twin: the same steps over sorted rows.  A
registry holds `capacity` jobs at most, so the state of a key is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestream.streaming.streams import TERMINAL

TTL, CAPACITY = 900.0, 100
CHANGES = ["admitted", "refused", "evicted", "ended", "expired"]
OUT = "registry string, job string, change string, at double"


def due(job: tuple[float, float | None], ttl: float) -> float | None:
    """When a job (admitted at, ended at) is forgotten."""
    admitted, ended = job
    return None if ended is None else max(ended, admitted + ttl)


def expire(jobs: dict[str, tuple], now: float, ttl: float) -> Iterator[tuple]:
    """Forget what is due by now, in order."""
    for when, job in sorted((t, k) for k, v in jobs.items() if (t := due(v, ttl)) is not None and t <= now):
        del jobs[job]
        yield job, "expired", when


def step(jobs: dict[str, tuple], job: str, event: str, at: float, ttl: float, capacity: int) -> Iterator[tuple]:
    """What one row changes; jobs is changed in place."""
    yield from expire(jobs, at, ttl)
    if event == "start" and job not in jobs:
        if len(jobs) >= capacity:
            ended = sorted((v[0], k) for k, v in jobs.items() if v[1] is not None)
            if not ended:
                yield job, "refused", at
                return
            del jobs[ended[0][1]]
            yield ended[0][1], "evicted", at
        jobs[job] = (at, None)
        yield job, "admitted", at
    elif event in TERMINAL and job in jobs and jobs[job][1] is None:
        jobs[job] = (jobs[job][0], at)
        yield job, "ended", at


def changes(events: DataFrame, ttl: float = TTL, capacity: int = CAPACITY, until: float | None = None) -> DataFrame:
    """The changes of a bounded table of events (registry, job, event, at, seq); jobs due by `until` are forgotten at the end.

    Rows of a registry follow each other by at, then seq.  Null registries and
    jobs have the empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, jobs, out = None, {}, []

        def close() -> None:
            if here is not None and until is not None:
                out.extend((here, *c) for c in expire(jobs, until, ttl))

        for batch in batches:
            for registry, job, event, at in zip(*(c.to_pylist() for c in batch.columns)):
                if registry != here:
                    close()
                    here, jobs = registry, {}
                out.extend((registry, *c) for c in step(jobs, job, event, at, ttl, capacity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    names = ["registry", "job", "change", "at"]
    rows = events.select(F.coalesce("registry", F.lit("")).alias("registry"), F.coalesce("job", F.lit("")).alias("job"), "event", F.col("at").cast("double").alias("at"), "seq")
    return rows.repartition("registry").sortWithinPartitions("registry", "at", "seq").select("registry", "job", "event", "at").mapInArrow(run, OUT)


class Registry(StatefulProcessor):
    """The stream's processor: jobs as map state, one timer a registry for the next job that is due."""

    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job string", "admitted double, ended double")

    def _load(self) -> dict[str, tuple]:
        return {k[0]: (v[0], v[1]) for k, v in self.jobs.iterator()}

    def _store(self, before: dict, now: dict) -> None:
        for k in before.keys() - now.keys():
            self.jobs.removeKey((k,))
        for k, v in now.items():
            if before.get(k) != v:
                self.jobs.updateValue((k,), v)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [t for v in now.values() if (t := due(v, self.ttl)) is not None]
        if times:
            self.handle.registerTimer(int(min(times) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._load()
        jobs, out = dict(before), []
        frame = pd.concat(list(rows)).sort_values(["at", "seq"])
        for job, event, at in zip(frame["job"], frame["event"], frame["at"]):
            out.extend((key[0], *c) for c in step(jobs, job, event, at, self.ttl, self.capacity))
        self._store(before, jobs)
        yield pd.DataFrame(out, columns=["registry", "job", "change", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._load()
        jobs = dict(before)
        out = [(key[0], *c) for c in expire(jobs, expiredTimerInfo.getExpiryTimeInMs() / 1000, self.ttl)]
        self._store(before, jobs)
        yield pd.DataFrame(out, columns=["registry", "job", "change", "at"])

    def close(self) -> None:
        pass


def stream_changes(events: DataFrame, at: str = "time", late: str = "0 seconds", ttl: float = TTL, capacity: int = CAPACITY) -> DataFrame:
    """The changes on a stream of (registry, job, event, seq and a timestamp column `at`); timers run as the watermark passes them.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.withWatermark(at, late).withColumn("at", F.unix_micros(at) / 1e6)
    return rows.groupBy("registry").transformWithStateInPandas(statefulProcessor=Registry(ttl, capacity), outputStructType=OUT, outputMode="append", timeMode="EventTime")
