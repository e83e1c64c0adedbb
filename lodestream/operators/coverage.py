"""Coverage of a search: what each source contributed, why it did not, and how the search ended.

All functions work on tables of many searches; a search is a key column, and
the roll-ups are joins and aggregations by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources reached through a web index only (fixed values).
WEB_INDEXED = ["x", "threads", "reddit"]
#: Gap reason by error or state (fixed values).
REASONS = {
    "external_limit": "EXTERNAL_LIMIT", "access_limited": "EXTERNAL_LIMIT", "http_403": "EXTERNAL_LIMIT", "timeout": "TIMEOUT", "rate_limited": "RATE_LIMITED", "quota_exhausted": "RATE_LIMITED", "circuit_open": "CIRCUIT_OPEN",
    "restricted": "RESTRICTED", "auth_required": "RESTRICTED", "unconfigured": "UNCONFIGURED", "configuration_missing": "UNCONFIGURED", "disabled": "UNCONFIGURED", "unavailable": "UNAVAILABLE", "temporarily_unavailable": "UNAVAILABLE",
}
#: Error codes that lie outside of the engine (fixed values).
EXTERNAL = ["access_limited", "auth_required", "captcha_blocked", "circuit_open", "dns_network", "http_403", "quota_exhausted", "rate_limited", "timeout", "upstream_5xx", "upstream_engines_unavailable"]
#: Health state by error code (fixed values); other codes are degraded.
HEALTH = {
    "unconfigured": "unconfigured", "configuration_missing": "unconfigured", "restricted_access": "restricted", "capability_restricted": "restricted", "access_limited": "access_limited", "auth_required": "auth_required",
    "quota_exhausted": "quota_exhausted", "disabled": "disabled", "rate_limited": "rate_limited", "http_403": "external_limit", "http_401": "unavailable", "http_404": "unavailable", "dns_network": "unavailable",
}
STORED = ["LOCAL_MEMORY", "HISTORICAL_INDEX"]


def _mapped(x: Column, values: dict[str, str], otherwise: str) -> Column:
    found = F.lit(None).cast("string")
    for key, value in values.items():
        found = F.when(x == key, value).otherwise(found)
    return F.coalesce(found, F.lit(otherwise))


def health_state(code: Column, partial: Column) -> Column:
    """State of a source after a run with an error code (null: none), and whether it gave items all the same."""
    return F.when(code.isNull(), "healthy").when(partial, "degraded").otherwise(_mapped(code, HEALTH, "degraded"))


def gap_reasons(sources: DataFrame, runs: DataFrame, final: DataFrame, key: str, web_enabled: bool) -> DataFrame:
    """One row a search and source: selected, executed, contributed, matched, admitted, final, reason (null: no gap).

    sources: key, source, state, selected; runs (at most one a search and
    source): key, source, error, matched, admitted; final: key, source of each
    result row.
    """
    counted = final.groupBy(key, "source").agg(F.count(F.lit(1)).alias("final"))
    rows = sources.join(runs.withColumn("executed", F.lit(True)), [key, "source"], "left").join(counted, [key, "source"], "left")
    rows = rows.withColumns({"executed": F.coalesce("executed", F.lit(False)), "matched": F.coalesce("matched", F.lit(0)), "admitted": F.coalesce("admitted", F.lit(0)), "final": F.coalesce("final", F.lit(0))})
    error, state = F.lower(F.coalesce("error", F.lit(""))), F.lower("state")
    not_selected = F.when(F.col("source").isin(WEB_INDEXED) & F.lit(not web_enabled), "WEB_DISCOVERY_DISABLED").otherwise(_mapped(state, REASONS, "NOT_SELECTED"))
    reason = (
        F.when(F.col("executed") & (error != ""), _mapped(error, REASONS, "FAILED")).when(F.col("executed") & (F.col("matched") == 0), "NO_MATCHES")
        .when(~F.col("selected"), not_selected).when(~F.col("executed"), "NOT_SELECTED")
    )
    return rows.select(key, "source", "selected", "executed", (F.col("final") > 0).alias("contributed"), "matched", "admitted", "final", reason.alias("reason"), (F.col("executed") & (error != "")).alias("failed"))


def coverage_status(gaps: DataFrame, key: str) -> DataFrame:
    """PARTIAL where a source that ran failed, LIMITED where any gap is left, else COMPLETE_ATTEMPT."""
    a = gaps.groupBy(key).agg(F.max("failed").alias("failed"), F.count("reason").alias("n_gaps"), F.sum(F.col("contributed").cast("long")).alias("n_contributed"))
    return a.select(key, "n_gaps", "n_contributed", F.when(F.col("failed"), "PARTIAL").when(F.col("n_gaps") > 0, "LIMITED").otherwise("COMPLETE_ATTEMPT").alias("status"))


def lanes(funnel: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """key, lane, candidates, final: live, local memory and historical.

    funnel: key, path, admitted; final: key, paths (array), historical.  A
    result counts in every lane it came by.
    """
    lane_of = F.when(F.col("path") == "LOCAL_MEMORY", "LOCAL_MEMORY").when(F.col("path") == "HISTORICAL_INDEX", "HISTORICAL").otherwise("LIVE")
    came = funnel.groupBy(key, lane_of.alias("lane")).agg(F.sum("admitted").alias("candidates"))
    live = F.exists("paths", lambda p: ~p.isin(STORED))
    own = F.array_compact(F.array(F.when(live, "LIVE"), F.when(F.array_contains("paths", "LOCAL_MEMORY"), "LOCAL_MEMORY"), F.when(F.array_contains("paths", "HISTORICAL_INDEX") | F.col("historical"), "HISTORICAL")))
    stayed = final.select(key, F.explode(own).alias("lane")).groupBy(key, "lane").agg(F.count(F.lit(1)).alias("final"))
    both = came.join(stayed, [key, "lane"], "full_outer")
    return both.select(key, "lane", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("final", F.lit(0)).alias("final"))


def outcome(searches: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Why each search ended with what it has: reason, cause, and the number of failed sources.

    searches: key, results, planned (sources), time_range; runs: key, source,
    error, items, query_matches, time_eligible.
    """
    failed = F.col("error").isNotNull() & (F.col("items") == 0)
    a = runs.groupBy(key).agg(
        F.countDistinct("source").alias("n_sources"), F.countDistinct(F.when(failed, F.col("source"))).alias("n_failed"),
        F.countDistinct(F.when(failed & ~F.col("source").isin(WEB_INDEXED), F.col("source"))).alias("n_failed_elsewhere"),
        F.max((F.col("query_matches") > F.col("time_eligible"))).alias("filtered"), F.min(F.coalesce(F.col("error").isin("unconfigured", "configuration_missing"), F.lit(False))).alias("all_unconfigured"),
    )
    external = runs.groupBy(key, "source").agg(F.max(failed).alias("failed"), F.max(F.coalesce(F.col("error").isin(EXTERNAL), F.lit(False))).alias("external")).filter("failed").groupBy(key).agg(F.min("external").alias("all_external"))
    rows = searches.join(a, key, "left").join(external, key, "left")
    all_failed = (F.col("n_failed") > 0) & (F.col("n_failed") == F.col("n_sources"))
    blocked = (F.col("n_failed_elsewhere") == 0) & F.col("all_unconfigured")
    reason = (
        F.when(F.col("results") > 0, "RESULTS_AVAILABLE").when((F.col("planned") == 0) | F.col("n_sources").isNull(), "NO_CAPABLE_SOURCE")
        .when((F.col("time_range") != "all") & F.col("filtered"), "NO_MATCHES_IN_TIME_RANGE").when(all_failed & blocked, "WEB_DISCOVERY_BLOCKED").when(all_failed, "ALL_SELECTED_SOURCES_FAILED").otherwise("NO_MATCHES")
    )
    rows = rows.withColumn("reason", reason)
    cause = F.when(F.col("reason") == "ALL_SELECTED_SOURCES_FAILED", F.when(F.col("all_external"), "EXTERNAL_LIMIT").otherwise("SOURCE_UNAVAILABLE"))
    return rows.select(key, "reason", cause.alias("cause"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def health_roll_up(runs: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Per source: runs, mean latency, failures, recoveries (a good run after a bad one) and the last state.

    runs: latency_ms, error, items, in the order given (a total one).
    """
    from pyspark.sql.window import Window

    state = health_state(F.col("error"), F.col("items") > 0)
    rows = runs.withColumn("state", state)
    before = F.lag("state").over(Window.partitionBy(source).orderBy(*order))
    recovered = (F.col("state") == "healthy") & ~F.coalesce(before.isin("healthy", "unconfigured"), F.lit(True))
    rows = rows.withColumn("recovered", recovered)
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("latency_ms").alias("mean_latency"), F.count("error").alias("failures"), F.sum(F.col("recovered").cast("long")).alias("recoveries"),
        F.max_by("state", F.struct(*order)).alias("state"), F.max_by("error", F.struct(*order)).alias("last_error"),
    )
