"""Calibrated uncertainty, saturation and shadow routing: what an adaptive policy would have decided, beside what was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import rounded

#: Risk points of an observation by its first bound that holds (fixed values).
RISKS = {
    "candidates": ("<", [(5, 2), (10, 1)]),
    "sources": ("<=", [(1, 2), (2, 1)]),
    "completeness": ("<", [(0.45, 2), (0.65, 1)]),
    "agreement": ("<", [(0.35, 2), (0.60, 1)]),
    "disagreement": (">", [(30, 2), (20, 1)]),
    "margin": ("<", [(3, 2), (8, 1)]),
    "unqueried": (">=", [(3, 2), (1, 1)]),
}
#: A round has saturated below this share of the round before, in unique and in admitted results (fixed value).
SATURATED = 0.15
#: Sources that stay whatever was learned: the first so many, and those this capable; and what defers another (fixed values).
PROTECTED, CAPABLE, ENOUGH, WEAK, BEHIND = 4, 90.0, 5, -1.5, 18.0


def with_previous(rounds: DataFrame, search: str, round_no: str = "round") -> DataFrame:
    """rounds with the unique and admitted gain of the round before, as `before_unique` and `before_admitted`."""
    w = Window.partitionBy(search).orderBy(round_no)
    return rounds.withColumns({"before_unique": F.lag("unique").over(w), "before_admitted": F.lag("admitted").over(w)})


def saturated() -> Column:
    """Whether both gains fell below a share of the round before; an empty round before counts by its unique results, and as one at least."""
    one = lambda x: F.greatest(F.lit(1), x)
    base = F.when(F.coalesce(F.col("before_admitted"), F.lit(0)) != 0, F.col("before_admitted")).otherwise(F.col("before_unique"))
    low = (F.col("unique") / one(F.col("before_unique")) < SATURATED) & (F.col("admitted") / one(base) < SATURATED)
    return F.coalesce((F.col("round") > 1) & F.col("before_unique").isNotNull() & low, F.lit(False))


def risk() -> Column:
    """Risk points of a row with the columns of RISKS, single_engine, degraded, hard, and those of `saturated`."""
    tests = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}

    def points(name: str) -> Column:
        kind, bounds = RISKS[name]
        return reduce(lambda made, b: made.when(tests[kind](F.col(name), F.lit(b[0])), b[1]), bounds[1:], F.when(tests[kind](F.col(name), F.lit(bounds[0][0])), bounds[0][1])).otherwise(0)

    less = lambda total, test, by: F.greatest(F.lit(0), total - F.when(test, by).otherwise(0))
    total = sum((points(name) for name in RISKS), F.lit(0)) + F.col("single_engine").cast("int") + F.col("degraded").cast("int") + (F.col("hard") & (F.col("unqueried") > 0)).cast("int")
    coherent = (F.col("sources") >= 4) & (F.col("candidates") >= 15) & (F.col("completeness") >= 0.70) & (F.col("agreement") >= 0.70)
    return less(less(less(total, saturated(), 2), coherent, 2), F.col("unqueried") == 0, 1)


def level(points: Column) -> Column:
    return F.when(points <= 1, "LOW").when(points <= 4, "MEDIUM").otherwise("HIGH")


def saturation(of: Column, seconds: int, requests: int, rounds: int) -> Column:
    """The reason to stop, or UNCERTAINTY_WITH_AVAILABLE_COVERAGE to go on: budgets first, then coverage, gain and the level `of` the risk."""
    return (
        F.when(F.col("elapsed") >= seconds, "TIME_BUDGET").when(F.col("requests") >= requests, "REQUEST_BUDGET").when(F.col("round") >= rounds, "MAX_ROUNDS")
        .when(F.col("unqueried") == 0, "SOURCE_EXHAUSTION").when(saturated(), "LOW_MARGINAL_GAIN").when(of.isin("MEDIUM", "HIGH"), "UNCERTAINTY_WITH_AVAILABLE_COVERAGE").otherwise("SATISFIED")
    )


def shadow_route(rows: DataFrame, query: str) -> DataFrame:
    """query, source, place, shadow_place, expected, recommendation, reason of every source planned for a query.

    rows: query, source, total, capability, available, adjustment and
    observations (null: nothing learned), a few sources a query.  The order is
    by total plus adjustment; the first PROTECTED and the capable stay, others
    are deferred only on enough evidence of weak use far behind the best.
    """
    expected = F.col("total") + F.coalesce("adjustment", F.lit(0.0))
    own = Window.partitionBy(query)
    ranked = rows.withColumn("expected", expected).withColumns({
        "place": F.row_number().over(own.orderBy(F.col("total").desc(), "source")), "shadow_place": F.row_number().over(own.orderBy(F.col("expected").desc(), "source")), "best": F.max("expected").over(own),
    })
    protected = (F.col("shadow_place") <= PROTECTED) | (F.col("capability") >= CAPABLE)
    known = F.coalesce(F.col("observations") >= ENOUGH, F.lit(False))
    weak = F.coalesce(F.col("adjustment") <= WEAK, F.lit(False))
    reason = (
        F.when(~F.col("available"), "unavailable").when(protected, "protected").when(~known, "insufficient evidence").when(~weak | (F.col("expected") >= F.col("best") - BEHIND), "competitive").otherwise("low yield")
    )
    keep = ~reason.isin("unavailable", "low yield")
    return ranked.select(query, "source", "place", "shadow_place", rounded(F.col("expected"), 3).alias("expected"), F.when(keep, "SELECT").otherwise("DEFER").alias("recommendation"), reason.alias("reason"))
