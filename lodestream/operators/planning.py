"""Planner and learning operators as column expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import clamp, rounded
from lodestream.operators.ordering import last, running_sums

#: Search budgets (fixed values): seconds, rounds, source calls.
BUDGETS = {"fast": (5, 1, 6), "balanced": (12, 2, 12), "deep": (25, 3, 20)}


def utility(rows: DataFrame) -> DataFrame:
    """Long-term and total utility of a source for a query.

    rows: capability, intent, language, temporal (0..100), yields, unique,
    duplicates (0..1), latency_ms, availability (0..100).
    """
    latency = F.greatest(F.lit(20.0), 100.0 - F.least(F.col("latency_ms"), F.lit(8000.0)) / 100.0)
    duplicate = F.greatest(F.lit(0.0), 100.0 * (1.0 - clamp(F.col("duplicates"), 0.0, 1.0)))
    observed, unique = 100.0 * clamp(F.col("yields"), 0.0, 1.0), 100.0 * clamp(F.col("unique"), 0.0, 1.0)
    long_term = 0.27 * F.col("capability") + 0.23 * F.col("intent") + 0.10 * F.col("language") + 0.10 * F.col("temporal") + 0.10 * observed + 0.08 * unique + 0.05 * latency + 0.04 * duplicate + 0.03 * (unique + duplicate) / 2
    return rows.withColumn("long_term", rounded(long_term, 4)).withColumn("total", rounded(F.col("long_term") * (0.25 + 0.75 * F.col("availability") / 100.0), 4))


def rounds(rows: DataFrame, query: str, max_calls: int, max_rounds: int) -> DataFrame:
    """Sources in utility order, cut to the calls allowed and dealt evenly to at most two rounds."""
    w = Window.partitionBy(query)
    ranked = rows.withColumn("position", F.row_number().over(w.orderBy(F.col("total").desc(), "source"))).filter(F.col("position") <= max_calls)
    chunk = F.ceil(F.count(F.lit(1)).over(w) / min(2, max_rounds))
    return ranked.withColumn("round", F.ceil(F.col("position") / chunk)).filter(F.col("round") <= max_rounds)


def uncertainty(candidates: DataFrame, by: str, order: str | None = None) -> DataFrame:
    """Risk points and level per search; candidates: source, completeness, engine, variant, lexical, semantic.

    With a column that orders a search's candidates, means are the same to the
    last bit however the candidates are dealt.
    """
    sums, mean = candidates.withColumn("gap", F.abs(F.col("lexical") - F.col("semantic"))), F.avg
    if order is not None:
        sums = running_sums(sums, [by], order, {"gap_sum": F.col("gap"), "completeness_sum": F.col("completeness")})
        mean = lambda c: F.try_divide(last(f"{c}_sum", order), F.count(c))
    a = sums.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), mean("completeness").alias("completeness"),
        F.countDistinct("engine").alias("engines"), F.countDistinct("variant").alias("variants"), F.coalesce(mean("gap"), F.lit(0.0)).alias("disagreement"),
    )
    points = (
        F.when(F.col("n") < 5, 2).when(F.col("n") < 10, 1).otherwise(0)
        + (F.col("sources") == 1).cast("int")
        + F.when(F.col("completeness") < 0.35, 2).when(F.col("completeness") < 0.6, 1).otherwise(0)
        + (F.col("engines") == 1).cast("int")
        + F.when(F.col("disagreement") > 35, 2).otherwise(0)
    )
    points = F.when(F.col("variants") > 1, F.greatest(F.lit(0), points - 1)).otherwise(points)
    a = a.withColumn("risk", points)
    broad = (F.col("sources") >= 3) & (F.col("n") >= 10) & (F.col("completeness") >= 0.55)
    a = a.withColumn("risk", F.when(broad, F.greatest(F.lit(0), F.col("risk") - 2)).otherwise(F.col("risk")))
    return a.withColumn("level", F.when(F.col("risk") <= 1, "LOW").when(F.col("risk") <= 3, "MEDIUM").otherwise("HIGH"))


def gain(urls: Column, admitted: Column, platforms: Column, stories: Column, aliases: Column, requests: Column, elapsed_ms: Column) -> Column:
    useful = urls + 1.5 * admitted + 2.0 * platforms + 1.5 * stories + aliases
    return F.log1p(useful.cast("double")) / F.greatest(F.lit(1.0), requests + elapsed_ms / 5000.0)


def stop_reason(level: Column, gained: Column, results: Column, limit: int, round_no: Column, max_rounds: int, unqueried: Column, elapsed: Column | None = None, max_seconds: float = 0.0, requests: Column | None = None, max_requests: int = 0, available: Column | None = None, attempt_more: Column | None = None) -> Column:
    """The first rule that ends a search; null: go on.

    Time and requests end it first; a search that has to attempt more is not
    ended by what it has.  Without available sources the last rule names that.
    """
    no = F.lit(False)
    more = F.coalesce(attempt_more, no) if attempt_more is not None else no
    late = elapsed >= max_seconds if elapsed is not None else no
    spent = (requests >= max_requests) & (unqueried > 0) if requests is not None else no
    none_left = available == 0 if available is not None else no
    return (
        F.when(late, "TIME_BUDGET")
        .when(spent, "REQUEST_BUDGET")
        .when((results >= limit) & ~more, "USER_LIMIT")
        .when((level == "LOW") & (results >= min(10, limit)) & ~more, "SATISFIED")
        .when((round_no > 1) & (gained < 0.12), "LOW_MARGINAL_GAIN")
        .when((unqueried > 0) & (round_no < max_rounds), F.lit(None).cast("string"))
        .when(round_no >= max_rounds, "MAX_ROUNDS")
        .when(none_left, "NO_AVAILABLE_SOURCES")
        .otherwise("SOURCE_EXHAUSTION")
    )


def outcome(results: Column, code: Column, completed: Column) -> Column:
    blocked, down = ["captcha_blocked", "http_403", "restricted_access"], ["engines_temporarily_unavailable", "rate_limited", "timeout", "dns_network", "upstream_5xx"]
    code = F.lower(F.coalesce(code, F.lit("")))
    return F.when(results > 0, "RESULT").when(code.isin(blocked), "BLOCKED").when(code.isin(down), "UNAVAILABLE").when(completed & (code == ""), "NO_RESULT").otherwise("ERROR")


def learned_adjustment(observed: DataFrame, by: list[str], now: Column, half_life_days: float = 30.0, least: int = 5, most: float = 8.0) -> DataFrame:
    """Time-decayed utility of each group, centred and clamped; too few observations give 0.

    observed: at, returned, admitted, unique_count, top_k, duplicate_rate, latency_ms, failed.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 8.64e10)
    weight = F.pow(F.lit(0.5), age / half_life_days)
    one = lambda x: F.least(F.lit(1.0), x)
    returned = F.greatest(F.lit(1), F.col("returned"))
    score = 0.35 * one(F.col("admitted") / returned) + 0.30 * one(F.col("unique_count") / returned) + 0.20 * one(F.col("top_k") / F.greatest(F.lit(1), F.col("admitted"))) - 0.10 * one(F.col("duplicate_rate")) - 0.03 * one(F.col("latency_ms") / 8000) - 0.02 * F.col("failed").cast("int")
    sums = observed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * score).alias("s"), F.sum(weight).alias("w"))
    centred = (F.col("s") / F.greatest(F.col("w"), F.lit(1e-9)) - 0.35) * 10
    return sums.select(*by, "n", F.when(F.col("n") < least, 0.0).otherwise(rounded(F.greatest(F.lit(-most), F.least(F.lit(most), centred)), 3)).alias("adjustment"))
