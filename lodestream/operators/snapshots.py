"""Configuration slots as an append log, with rollback.

A row of the log puts its version into a slot, or rolls back: production and
previous production change places.  Nothing is overwritten, so the slots as of
any version can be read off the log.  A rollback without both is refused and
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.scan import segmented_scan

#: Names of slots (fixed values), in the order of the state.
SLOTS = ["VERIFIED_PRODUCTION", "PREVIOUS_PRODUCTION", "EXPERIMENTAL", "PROMOTION_CANDIDATE"]
ROLLBACK = "ROLLBACK"
COLUMNS = ["production", "previous", "experimental", "candidate"]


def step(state: tuple, version: int, op: str | None) -> tuple:
    """(slots, applied) after one row."""
    if op == ROLLBACK:
        if state[0] is None or state[1] is None:
            return state, False
        return (state[1], state[0], *state[2:]), True
    if op not in SLOTS:
        return state, False
    k = SLOTS.index(op)
    return (*state[:k], version, *state[k + 1 :]), True


def effect(stretch: list[tuple]) -> dict[tuple[bool, bool], tuple]:
    """The slots after a stretch, by whether production and previous were there before it: a version, or -1 - k for what slot k held."""
    out = {}
    for production in (True, False):
        for previous in (True, False):
            state = (-1 if production else None, -2 if previous else None, -3, -4)
            for version, op in stretch:
                state, _ = step(state, version, op)
            out[production, previous] = state
    return out


def through(state: tuple, table: dict) -> tuple:
    found = table[state[0] is not None, state[1] is not None]
    return tuple(state[-1 - v] if v is not None and v < 0 else v for v in found)


def slots(log: DataFrame, by: str, version: str, op: str) -> DataFrame:
    """by, version, op, applied, and the version in each slot after every row of the log.

    Versions of a key are distinct and not negative.  op is a slot's name or
    ROLLBACK; another one, or null, is refused.  Null keys are one key.
    """

    def one(state: tuple, v: int, what: str | None) -> tuple:
        state, applied = step(state, v, what)
        return state, applied, *state

    rows = log.select(by, F.col(version).cast("long").alias(version), F.col(op).alias(op))
    return segmented_scan(rows, by, [version], [version, op], effect, through, one, (None,) * 4, "applied boolean, " + ", ".join(f"{c} long" for c in COLUMNS))


def as_of(states: DataFrame, by: str, version: str, at: int) -> DataFrame:
    """by and the slots that were in force at a version: those after the last row up to it."""
    last = states.filter(F.col(version) <= at).groupBy(by).agg(F.max_by(F.struct(*COLUMNS), version).alias("s"))
    return last.select(by, "s.*")
