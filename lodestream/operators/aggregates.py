"""Roll-ups: buckets, histograms, quantiles, top terms, funnels.

Every function is one aggregation (map-side combined) over projected columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions import text
from lodestream.functions.numbers import rounded
from lodestream.sources.scratch import materialise

#: Words that say nothing about a topic (fixed values): English, and normalised Arabic ones.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with",
    "اذ", "اذا", "الى", "ان", "او", "اي", "بها", "به", "بين", "تلك", "ثم", "هذا", "هذه", "ذلك", "عن", "علي", "في", "كان", "كما", "لا", "ما", "مع", "من", "هو", "هي", "و", "يا",
]
MOST_COUNTED = 500_000  # terms that a task keeps before it hands on their counts
URL = r"(?i)https?://\S+|www\.\S+"
#: Steps of time buckets by name, in seconds, and each scope's days, step and number of buckets (fixed values).
STEPS = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400}
SCOPES = {"24h": (1, "1h", 24), "7d": (7, "6h", 28), "30d": (30, "24h", 30), "all": (None, "1h", 24)}


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    """One count per value of each column, as (dimension, value, n): a single pass by grouping sets."""
    sets = [[c] for c in columns]
    grouped = rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    dimension = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns))
    value = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in columns))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def time_buckets(rows: DataFrame, at: str, start: Column, end: Column, n: int) -> DataFrame:
    """bucket (0..n-1), n_rows between start and end inclusive, empty buckets included; the last takes the end."""
    n = max(1, min(366, n))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    span = F.greatest(F.lit(1.0), seconds(end) - seconds(start))
    inside = rows.filter((F.col(at) >= start) & (F.col(at) <= end))
    found = inside.select(F.least(F.lit(n - 1), F.floor((seconds(F.col(at)) - seconds(start)) / (span / n))).cast("long").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    spine = rows.sparkSession.range(n).withColumnRenamed("id", "bucket")
    return spine.join(F.broadcast(found), "bucket", "left").select("bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def trend(buckets: DataFrame, n: int) -> DataFrame:
    """Percent change of the mean of the second half of the buckets over the first, within -100..500."""
    half = n // 2
    first = F.sum(F.when(F.col("bucket") < half, F.col("n_rows")).otherwise(0)) / max(1, half)
    second = F.sum(F.when(F.col("bucket") >= half, F.col("n_rows")).otherwise(0)) / max(1, n - half)
    change = rounded(F.greatest(F.lit(-100.0), F.least(F.lit(500.0), F.try_divide((F.col("second") - F.col("first")) * 100, F.col("first")))), 2)
    means = buckets.agg(first.alias("first"), second.alias("second"))
    return means.select("first", "second", F.when(F.col("first") == 0, F.when(F.col("second") > 0, 100.0).otherwise(0.0)).otherwise(change).alias("trend"))


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """Counts in five score bands, empty bands included."""
    band = F.least(F.lit(80), F.floor(F.col(score) / 20) * 20).cast("long")
    found = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(5).select((F.col("id") * 20).alias("band"))
    return spine.join(F.broadcast(found), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def age_distribution(rows: DataFrame, at: str, now: Column) -> DataFrame:
    day = lambda n: now - F.expr(f"INTERVAL {n} DAYS")
    label = F.when(F.col(at).isNull(), "unavailable").when(F.col(at) >= day(1), "last_24h").when(F.col(at) >= day(7), "last_7d").when(F.col(at) >= day(30), "last_30d").otherwise("older")
    return rows.groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def related_terms(rows: DataFrame, words: Column, k: int = 12, skip: list[str] = STOPWORDS) -> DataFrame:
    """The k terms in most documents; ties by term."""
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(skip))
    return _top_terms(rows.select(kept.alias("words")), k)


def _top_terms(rows: DataFrame, k: int) -> DataFrame:
    """The k terms in most of `words`, arrays of distinct words or strings of such, as `topic_words` makes; tasks hand on counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter()
        for batch in batches:
            column = batch.column(0)
            if pa.types.is_list(column.type):
                found = pc.value_counts(column.flatten())
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["term", "n"])
                continue
            for words in column.to_pylist():
                own.update(words.split())
            if len(own) > MOST_COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["term", "n"])
                own = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["term", "n"])

    terms = rows.select("words").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))
    return terms.orderBy(F.col("n_docs").desc(), "term").limit(k)


def topic_words(title: Column, body: Column, skip: list[str]) -> Column:
    """The distinct words of more than two characters of title and text, without urls and those to skip, with a space between."""
    return F.arrow_udf(_topic_words(frozenset(skip)), "string", F.ArrowUDFType.SCALAR)(F.concat_ws(" ", title, body))


def _topic_words(skip: frozenset[str]):
    url = re.compile(URL, re.ASCII)  # white space as in the expressions of columns

    def run(texts: pa.Array) -> pa.Array:
        made = []
        for x in texts.to_pylist():
            own = text.words_of(url.sub(" ", x))[0] if "://" in x or "." in x else text.words_of(x)[0]
            made.append(" ".join([w for w in dict.fromkeys(own) if len(w) > 2 and w not in skip]))
        return pa.array(made, pa.string())

    return run


def snapshot_skip(query_words: list[str] | None = None) -> list[str]:
    """Words that no snapshot of a query names."""
    return sorted({*STOPWORDS, *(query_words or [])})


def snapshot(items: DataFrame, now: Column, scope: str = "all", query_words: list[str] | None = None) -> DataFrame:
    """An analytics snapshot as rows (key, label, value).

    items: item_id, source, category, language, title, text (or in their place
    words, the `topic_words`), canonical_url, published_at, fetched_at, score,
    engagement, reach (both null without metrics), hashtags, mentions.  The scope filters by fetch time and sets the
    buckets; for "all" their step spans the published times.  Ties among terms
    and marks are decided by name.
    """
    days, step, n = SCOPES[scope]
    rows = items if days is None else items.filter(F.col("fetched_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    if "words" not in rows.columns:
        rows = rows.withColumn("words", topic_words(F.col("title"), F.col("text"), snapshot_skip(query_words))).drop("title", "text")
    rows = materialise(rows, "snapshot")  # one pass over the texts
    social, news = rows.filter("category = 'social'"), rows.filter("category = 'news'")
    value = lambda key, x: F.struct(F.lit(key).alias("key"), F.lit("").alias("label"), x.cast("double").alias("value"))
    is_social = F.col("category") == "social"
    one = rows.agg(
        F.array(
            value("total_results", F.count(F.lit(1))), value("unique_results", F.countDistinct("canonical_url")), value("source_count", F.countDistinct("source")),
            value("duplicate_count", F.count(F.lit(1)) - F.countDistinct("canonical_url")), value("average_score", rounded(F.coalesce(F.avg("score"), F.lit(0.0)), 2)), value("scored_record_count", F.count("score")),
            value("platform_diversity", F.countDistinct(F.when(is_social, F.col("source")))), value("average_social_reach", rounded(F.avg(F.when(is_social, F.col("reach"))), 2)),
        ).alias("v")
    ).select(F.explode("v").alias("v")).select("v.*")
    parts = [one]
    label = lambda frame, key, name, number: frame.select(F.lit(key).alias("key"), F.col(name).cast("string").alias("label"), F.col(number).cast("double").alias("value"))
    named = {"source": "platform_distribution", "category": "category_distribution", "language": "language_distribution"}
    by = counts(rows, *named)
    parts.append(by.select(F.coalesce(*(F.when(F.col("dimension") == d, F.lit(k)) for d, k in named.items())).alias("key"), F.col("value").alias("label"), F.col("n").cast("double").alias("value")))
    parts.append(label(counts(social, "source"), "social_source_distribution", "value", "n"))
    parts.append(label(score_histogram(rows.filter("score is not null"), "score").filter("n > 0"), "score_distribution", "band", "n"))
    parts.append(label(age_distribution(rows, "published_at", now), "publication_time_distribution", "age", "n"))
    parts.append(label(_top_terms(rows, 12), "top_related_terms", "term", "n_docs"))
    for key, column in (("top_hashtags", "hashtags"), ("top_mentioned_accounts", "mentions")):
        parts.append(label(top_marks(social, F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.trim(t) != "")), key, "mark", "n"))
    first = rows.agg(F.min("published_at").alias("first"))  # one row
    for prefix, part in (("", rows), ("social_", social), ("news_", news)):
        dated = part.filter("published_at is not null").select("published_at")
        start = F.col("first") if days is None else now - F.expr(f"INTERVAL {STEPS[step] * n} SECONDS")
        buckets = time_buckets(dated.join(F.broadcast(first)), "published_at", start, now, n)
        buckets = materialise(buckets, "buckets")  # n rows
        parts.append(label(buckets, f"{prefix}mentions_over_time", "bucket", "n_rows"))
        parts.append(trend(buckets, n).select(F.lit(f"{prefix}trend_percent").alias("key"), F.lit("").alias("label"), F.col("trend").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_marks(rows: DataFrame, marks: Column, k: int = 12) -> DataFrame:
    """The k most frequent marks (hashtags, mentions), every occurrence counted; ties by name."""
    found = rows.select(F.explode(F.transform(marks, lambda m: F.replace(F.lower(m), F.lit("ß"), F.lit("ss")))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.col("n").desc(), "mark").limit(k)


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact quartiles with linear interpolation, mean and range, per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("q"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return out.select(by, "n", "low", *(rounded(F.col("q")[i], 3).alias(name) for i, name in enumerate(("p25", "median", "p75"))), rounded(F.col("mean"), 3).alias("mean"), "high")


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Population deviation and the 95th nearest-rank percentile per group."""
    return rows.groupBy(by).agg(rounded(F.stddev_pop(value), 3).alias("deviation"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def component_stats(rows: DataFrame, columns: list[str], shares=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Per column: count, mean, deviation, and nearest-lower percentiles: the value at place floor(share x (n - 1)).

    Places come from a rank within each column's own ordered values, so a
    column is never collected.
    """
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").filter("v is not null")
    distinct = long.groupBy("component", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("component").orderBy("v")
    upto = distinct.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = long.groupBy("component").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v"), 3).alias("mean"), rounded(F.stddev_pop("v"), 3).alias("deviation"))
    placed = upto.join(total, "component")
    least = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("v")))
    return placed.groupBy("component", "n", "mean", "deviation").agg(*(rounded(least(q), 3).alias(f"p{round(100 * q)}") for q in shares))


def size_distribution(rows: DataFrame, group: str) -> DataFrame:
    """How many groups have each size."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def unique_identities(rows: DataFrame, group: Column, item: Column) -> DataFrame:
    """One row: distinct groups, an item without one counting for itself."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.coalesce(group.cast("string"), F.concat(F.lit("item:"), item.cast("string")))).alias("n_unique"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def funnel(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key with the count of each stage; a key that a stage lacks counts 0 there."""
    tagged = None
    for stage, rows in parts.items():
        one = rows.select(*keys, F.lit(stage).alias("stage"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*keys).agg(*(F.sum((F.col("stage") == s).cast("long")).alias(s) for s in parts))


def latest(rows: DataFrame, key: list[str], at: str, *values: str) -> DataFrame:
    """The row with the largest `at` per key (a total order), by max_by: no sort of the groups."""
    packed = F.max_by(F.struct(*values), F.col(at))
    return rows.groupBy(*key).agg(packed.alias("v"), F.max(at).alias(at), F.count(F.lit(1)).alias("n")).select(*key, at, "n", *(F.col(f"v.{c}").alias(c) for c in values))


def running(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(value).over(w))


def engine_utility(observed: DataFrame) -> DataFrame:
    """Per engine, platform and class of query: requests, how often it was there, what it yielded, mean latency."""
    return observed.groupBy("engine", "platform", "query_class").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("available").alias("available"), F.sum("canonical_yield").alias("canonical_yield"), rounded(F.avg("latency_ms"), 2).alias("latency_ms"),
    )


def quality_summary(searches: DataFrame) -> DataFrame:
    """what, name, value: counts, rates, means and distributions over searches, in one pass.

    searches: language, query_class, n_results, duration_ms, and diagnostics, a
    JSON document with stop_reason, requests_used and rounds (of round and
    uncertainty level; round 0 is none).  The level is that of the last round.
    """
    of = F.from_json("diagnostics", "stop_reason string, requests_used long, rounds array<struct<round:int,level:string>>")
    rows = searches.withColumn("d", of).withColumn("rounds", F.filter(F.coalesce("d.rounds", F.array().cast("array<struct<round:int,level:string>>")), lambda r: r["round"] > 0))
    level = F.try_element_at(F.array_sort("rounds"), F.lit(-1))["level"]
    one = lambda what, name, value: F.struct(F.lit(what).alias("what"), name.alias("name"), value.cast("double").alias("value"))
    every = F.lit("")
    facts = F.array(
        one("searches", every, F.lit(1)), one("zero_results", every, F.col("n_results") == 0), one("average_rounds", every, F.size("rounds")), one("average_requests", every, F.coalesce("d.requests_used", F.lit(0))), one("average_latency_ms", every, F.col("duration_ms")),
        one("language", F.col("language"), F.lit(1)), one("query_class", F.col("query_class"), F.lit(1)), one("stop_reason", F.col("d.stop_reason"), F.lit(1)), one("uncertainty", level, F.lit(1)),
    )
    each = rows.select(F.explode(facts).alias("f")).select("f.*").filter("name is not null")
    mean = F.col("what").isin("average_rounds", "average_requests", "average_latency_ms")
    sums = each.groupBy("what", "name").agg(F.sum("value").alias("s"), F.avg("value").alias("m")).withColumn("mean", mean)
    rates = sums.filter("what = 'zero_results'").select(F.lit("zero_result_rate").alias("what"), "name", rounded(F.col("m"), 4).alias("value"))
    return sums.select("what", "name", F.when(mean, rounded(F.col("m"), 2)).otherwise(F.col("s")).alias("value")).unionByName(rates)


def state_counts(sources: DataFrame, now_active: str = "active") -> DataFrame:
    """state, n of the system's sources: available, or why not (disabled before unconfigured before degraded before restricted)."""
    state = F.when(~F.col("enabled"), "disabled").when(~F.col("configured"), "unconfigured").when(F.col("health").isin("degraded", "timeout"), "degraded").when(F.col("health") == "restricted", "restricted").otherwise(now_active)
    return sources.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
