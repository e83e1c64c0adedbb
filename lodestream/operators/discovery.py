"""Web discoveries: merged by url, remembered, and what each engine is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import rounded
from lodestream.operators.vectors import weighted_rrf


def completeness(*values: Column) -> Column:
    """Share of the values that are there, of three digits."""
    known = sum(((v.isNotNull() & (v.cast("string") != "")).cast("int") for v in values), F.lit(0))
    return rounded(F.coalesce(known, F.lit(0)) / len(values), 3)


def merged(found: DataFrame) -> DataFrame:
    """One row a url: the first title and snippet there are, and the engines, variants and rounds that found it.

    found: key, seq (a total order), title, snippet, engine, variant, round,
    rank, engine_weight, confidence.  The score is the weighted reciprocal rank
    fusion over engines, variants and rounds.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("seq"))).alias(c)
    groups = found.groupBy("key").agg(first("title"), first("snippet"), F.countDistinct("engine", "variant").alias("support"), *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("engine", "variant", "round")))
    score = weighted_rrf(found).select("key", "score")
    return groups.join(score, "key", "left")


def ranked(candidates: DataFrame, limit: int = 100) -> DataFrame:
    """The best merged candidates: by score, support, completeness and url; a bounded top k."""
    return candidates.orderBy(F.col("score").desc(), F.col("support").desc(), F.col("completeness").desc(), "key").limit(min(limit, 100))


def remember(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records after new findings (key, title, snippet, language, completeness, seen_at).

    A finding at least as complete as its record refreshes the fields it has;
    any finding renews last_seen_at; a new key is a new record.
    """
    fields = ["title", "snippet", "language"]
    old = records.select("key", F.struct(*fields, "completeness", "first_seen_at", "last_seen_at").alias("o"))
    latest = found.groupBy("key").agg(F.max_by(F.struct(*fields, "completeness"), F.struct("completeness", "seen_at")).alias("n"), F.max("seen_at").alias("at"), F.min("seen_at").alias("since"))
    both = old.join(latest, "key", "full_outer")
    better = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.completeness") >= F.col("o.completeness")))
    nonempty = lambda c: F.when(c != "", c)
    fresh = {c: F.when(better, F.coalesce(nonempty(F.col(f"n.{c}")), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")) for c in fields}
    return both.select(
        "key", *(v.alias(c) for c, v in fresh.items()), F.when(better, F.col("n.completeness")).otherwise(F.col("o.completeness")).alias("completeness"),
        F.coalesce("o.first_seen_at", "since").alias("first_seen_at"), F.greatest("o.last_seen_at", "at").alias("last_seen_at"),
    )


def new_observations(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct observations that are not yet known."""
    return found.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def support(records: DataFrame, observations: DataFrame) -> DataFrame:
    """key, engines, variants and the number of independent (engine, variant) pairs of each record; none is 0."""
    o = observations.groupBy("key").agg(F.array_sort(F.collect_set("engine")).alias("engines"), F.array_sort(F.collect_set("variant")).alias("variants"), F.countDistinct("engine", "variant").alias("support"))
    none = F.array().cast("array<string>")
    return records.select("key").join(o, "key", "left").select("key", F.coalesce("engines", none).alias("engines"), F.coalesce("variants", none).alias("variants"), F.coalesce("support", F.lit(0)).alias("support"))


def engine_stats(telemetry: DataFrame, *by: str) -> DataFrame:
    """Sums of each engine's requests and the rates that follow; a rate over nothing is 0.

    telemetry: returned, target, accepted, duplicates, timeout, rate_limited,
    error (booleans), latency_ms.
    """
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    a = telemetry.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), *(n(c) for c in ("returned", "target", "accepted", "duplicates", "timeout", "rate_limited", "error")), F.sum("latency_ms").alias("latency"))
    rate = lambda x, y: rounded(F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0)), 4)
    return a.select(
        *by, "requests", "returned", "target", "accepted", "duplicates", "timeout", "rate_limited", "error", rate("target", "returned").alias("precision"), rate("accepted", "requests").alias("yields"),
        rate("duplicates", "accepted").alias("duplicate_rate"), rate("timeout", "requests").alias("timeout_rate"), rate("rate_limited", "requests").alias("rate_limit_rate"), rate("latency", "requests").alias("mean_latency"),
    )


def merged_instances(found: DataFrame) -> DataFrame:
    """Posts seen by several instances: one row a url (without its last slash), the first row wins, all instances named in order.

    found: url, seq (a total order), instance, text.
    """
    keyed = found.withColumn("key", F.regexp_replace("url", "/+$", ""))
    first = keyed.groupBy("key", "instance").agg(F.min("seq").alias("s"))
    order = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "instance"))), lambda x: x["instance"]).alias("instances"))
    own = keyed.groupBy("key").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return own.join(order, "key")


def variants_within_budget(variants: DataFrame, by: str, limit: int, engines: int) -> DataFrame:
    """The first `limit` distinct variants of each search, with the engines each may ask: the budget split evenly."""
    from pyspark.sql.window import Window

    one = variants.groupBy(by, "text").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy(by)
    kept = one.withColumn("n", F.row_number().over(w.orderBy("seq"))).filter(F.col("n") <= limit).withColumn("of", F.count(F.lit(1)).over(w))
    return kept.select(by, "text", "n", (F.floor(F.lit(engines) / F.col("of")) + (F.col("n") <= F.lit(engines) % F.col("of")).cast("long")).alias("engines"))
