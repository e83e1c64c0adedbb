"""Analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import numbers, text
from lodestream.functions.numbers import rounded
from lodestream.operators import aggregates as A
from lodestream.sources.tables import CONTENT_SQL, ENGAGEMENT_SQL, FRESHNESS_SQL, NOW_SQL, SPAM_SQL, content, documents, engagement, now, rounded_sql, table, tokens_sql


def analytics_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts(documents(spark, sf_dir), "source", "language")


CATEGORICAL_SQL = """SELECT 'source' AS dimension, source AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'language', lang, count(*) FROM documents GROUP BY 2"""


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir).select(numbers.freshness(F.col("published_at"), now()).alias("score"))
    return A.score_histogram(rows, "score")


HISTOGRAM_SQL = f"""WITH {CONTENT_SQL}, b AS (SELECT CAST(least(80, floor(({FRESHNESS_SQL}) / 20) * 20) AS BIGINT) AS band FROM content)
SELECT CAST(g.band AS BIGINT) AS band, count(b.band) AS n FROM range(0, 100, 20) g(band) LEFT JOIN b ON b.band = g.band GROUP BY 1"""


def age_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.age_distribution(content(spark, sf_dir).select("published_at"), "published_at", now())


AGE_SQL = f"""WITH {CONTENT_SQL} SELECT CASE WHEN published_at IS NULL THEN 'unavailable' WHEN published_at >= {NOW_SQL} - INTERVAL 1 DAY THEN 'last_24h'
  WHEN published_at >= {NOW_SQL} - INTERVAL 7 DAY THEN 'last_7d' WHEN published_at >= {NOW_SQL} - INTERVAL 30 DAY THEN 'last_30d' ELSE 'older' END AS age, count(*) AS n FROM content GROUP BY 1"""


def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts")
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 00:00:00", "2024-01-31 00:00:00"))
    return A.time_buckets(events, "ts", start, end, 30)


BUCKETS_SQL = """WITH b AS (SELECT least(29, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / (2592000.0 / 30)))::BIGINT AS bucket FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')
SELECT g.bucket, count(b.bucket) AS n_rows FROM range(30) g(bucket) LEFT JOIN b ON b.bucket = g.bucket GROUP BY 1"""


def time_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trend(time_buckets(spark, sf_dir), 30)


TREND_SQL = f"""WITH t AS ({BUCKETS_SQL}), m AS (SELECT sum(CASE WHEN bucket < 15 THEN n_rows ELSE 0 END) / 15.0 AS first, sum(CASE WHEN bucket >= 15 THEN n_rows ELSE 0 END) / 15.0 AS second FROM t)
SELECT first, second, CASE WHEN first = 0 THEN CASE WHEN second > 0 THEN 100.0 ELSE 0.0 END ELSE {rounded_sql('greatest(-100.0, least(500.0, (second - first) * 100 / first))', 2)} END AS trend FROM m"""


def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.related_terms(documents(spark, sf_dir), text.tokens(F.col("text")))


_SKIP = ", ".join(f"'{w}'" for w in A.STOPWORDS)
RELATED_SQL = f"""SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct({tokens_sql('text')})) AS term FROM documents)
WHERE length(term) > 2 AND term NOT IN ({_SKIP}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"""


def top_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in texts to which every document adds three of its own making: two tags, one in capitals, and a mention."""
    made = F.concat_ws(" ", "text", F.concat(F.lit("#Topic"), (F.col("item_id") % 23).cast("string")), F.concat(F.lit("#"), F.upper("language")), F.concat(F.lit("@"), "source"))
    rows = documents(spark, sf_dir).select(made.alias("text"))
    tags = A.top_marks(rows, text.hashtags(F.col("text"))).select(F.lit("hashtag").alias("kind"), "mark", "n")
    return tags.unionByName(A.top_marks(rows, text.mentions(F.col("text"))).select(F.lit("mention").alias("kind"), "mark", "n"))


HASHTAG_SQL = r"""WITH d AS (SELECT ' ' || text || ' #Topic' || (doc_id % 23) || ' #' || upper(lang) || ' @' || source AS text FROM documents
), h AS (SELECT lower(unnest(list_distinct(regexp_extract_all(text, '[^\p{L}\p{N}_]#([\p{L}\p{N}_]+)', 1)))) AS mark FROM d), m AS (SELECT lower(unnest(list_distinct(regexp_extract_all(text, '[^\p{L}\p{N}_]@([\p{L}\p{N}_.-]+)', 1)))) AS mark FROM d)
SELECT * FROM (SELECT 'hashtag' AS kind, mark, count(*) AS n FROM h GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12) UNION ALL SELECT * FROM (SELECT 'mention', mark, count(*) FROM m GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)"""


def engagement_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir).select("item_id", "source", engagement().alias("engagement"))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("engagement"), 4).alias("mean"), F.max("engagement").alias("high"))
    return per.withColumn("reach", numbers.social_reach(F.lit("mastodon"), F.col("mean"), F.lit(3)))


ENGAGED_SQL = f"""WITH {CONTENT_SQL}, e AS (SELECT source, {ENGAGEMENT_SQL} AS engagement FROM content), p AS (SELECT source, count(*) AS n, {rounded_sql('avg(engagement)', 4)} AS mean, max(engagement) AS high FROM e GROUP BY 1)
SELECT *, {rounded_sql('least(100.0, 0.8 * mean + 0.2 * 100 * (1 - exp(-1.0)))', 2)} AS reach FROM p"""


def most_engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir).filter(F.col("like_value").isNotNull() | F.col("k").isNotNull())
    return rows.select("item_id", "source", engagement().alias("engagement")).orderBy(F.col("engagement").desc(), "item_id").limit(10)


MOST_SQL = f"""WITH {CONTENT_SQL} SELECT item_id, source, {ENGAGEMENT_SQL} AS engagement FROM content WHERE like_value IS NOT NULL OR k IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 10"""


def quantiles_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "n_chars")
    return A.quantiles(rows, "source", "n_chars").join(A.spread(rows, "source", "n_chars"), "source")


QUANTILES_SQL = f"""SELECT source, count(n_chars) AS n, min(n_chars) AS low, {rounded_sql('quantile_cont(n_chars, 0.25)', 3)} AS p25, {rounded_sql('quantile_cont(n_chars, 0.5)', 3)} AS median,
  {rounded_sql('quantile_cont(n_chars, 0.75)', 3)} AS p75, {rounded_sql('avg(n_chars)', 3)} AS mean, max(n_chars) AS high, {rounded_sql('stddev_pop(n_chars)', 3)} AS deviation, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY 1"""


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "value")


LATEST_SQL = "SELECT user_id, max(event_id) AS event_id, count(*) AS n, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"


def acquisition_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.pmod("user_id", F.lit(20)).alias("platform")
    rows = e.select(key, "event_type", "value")
    parts = {"retrieved": rows, "matched": rows.filter("value >= 10"), "admitted": rows.filter("value >= 50"), "final": rows.filter("value >= 90")}
    return A.funnel(parts, ["platform", "event_type"])


FUNNEL_SQL = """SELECT user_id % 20 AS platform, event_type, count(*) AS retrieved, count(*) FILTER (WHERE value >= 10) AS matched, count(*) FILTER (WHERE value >= 50) AS admitted, count(*) FILTER (WHERE value >= 90) AS final
FROM events GROUP BY 1, 2"""


def grouping_sets_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged quality by language, by source and overall: one pass, three grouping sets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id").groupingSets([["lang"], ["source"], []], "lang", "source")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), rounded(F.avg("quality"), 4).alias("rate"))


SLICES_SQL = f"""SELECT lang, source, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic, {rounded_sql('avg(quality)', 4)} AS rate
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())"""


#: Values whose decimals are rounded, most of them ties or next to one, and to how many decimals.
_ROUNDED = {"value_0": ("value", 0), "value_1": ("value", 1), "value_2": ("value", 2), "value_4": ("value", 4), "eighths": ("event_id / 8", 2), "cents": ("event_id / 1000 + 0.005D", 2), "shares": ("1 / (event_id + 1)", 6), "signed": ("(event_id - 5000) / 16", 3)}


def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values, and quotients that are ties in decimal but seldom as doubles, rounded by their exact values."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return rows.select("event_id", *(rounded(F.expr(x), digits).alias(name) for name, (x, digits) in _ROUNDED.items()))


_DOUBLES = {"event_id / 8": "event_id / 8.0::DOUBLE", "event_id / 1000 + 0.005D": "event_id / 1000.0::DOUBLE + 0.005::DOUBLE", "1 / (event_id + 1)": "1.0::DOUBLE / (event_id + 1)", "(event_id - 5000) / 16": "(event_id - 5000) / 16.0::DOUBLE"}
ROUNDING_SQL = f"SELECT event_id, {', '.join(f'{rounded_sql(_DOUBLES.get(x, x), digits)} AS {name}' for name, (x, digits) in _ROUNDED.items())} FROM events"


def spam_and_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir)
    parts = {"url": (F.col("canonical_url").isNotNull(), 0.16), "title": (F.col("title") != "", 0.12), "snippet": (F.col("text") != "", 0.18), "full": (F.length("text") >= 80, 0.22), "author": (F.col("source").isNotNull(), 0.1), "time": (F.col("published_at").isNotNull(), 0.12)}
    score = sum((F.when(test, weight).otherwise(0.0) for test, weight in parts.values()), F.lit(0.0))
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(k)) for k, (test, _) in parts.items())))
    rows = rows.select("item_id", text.spam_penalty(F.col("title"), F.col("text"), F.col("canonical_url")).alias("spam"), rounded(score, 2).alias("completeness"), F.array_join(missing, ",").alias("missing"))
    return rows.withColumn("level", F.when(F.col("completeness") >= 0.75, "RICH").when(F.col("completeness") >= 0.45, "MODERATE").otherwise("SPARSE"))


COMPLETE_SQL = f"""WITH {CONTENT_SQL}, s AS (SELECT item_id, {SPAM_SQL} AS spam, {rounded_sql("0.16 + CASE WHEN title <> '' THEN 0.12 ELSE 0 END + CASE WHEN text <> '' THEN 0.18 ELSE 0 END + CASE WHEN length(text) >= 80 THEN 0.22 ELSE 0 END + 0.1 + CASE WHEN published_at IS NOT NULL THEN 0.12 ELSE 0 END", 2)} AS completeness,
  concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN text = '' THEN 'snippet' END, CASE WHEN length(text) < 80 THEN 'full' END, CASE WHEN published_at IS NULL THEN 'time' END) AS missing FROM content)
SELECT *, CASE WHEN completeness >= 0.75 THEN 'RICH' WHEN completeness >= 0.45 THEN 'MODERATE' ELSE 'SPARSE' END AS level FROM s"""


QUOTAS, SAMPLE = {"en": 30, "de": 15}, 90


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: quotas per language, then what is left fills the sample, in order of id."""
    from pyspark.sql.window import Window

    rows = documents(spark, sf_dir).select("item_id", "language")
    w = Window.partitionBy("language").orderBy("item_id")
    quota = F.lit(10)
    for language, n in QUOTAS.items():
        quota = F.when(F.col("language") == language, n).otherwise(quota)
    ranked = rows.withColumn("n", F.row_number().over(w)).withColumn("chosen", F.col("n") <= quota)
    # the quotas' rows come first, so one bounded top k holds them and the fill
    return ranked.orderBy(F.col("chosen").desc(), "item_id").limit(SAMPLE).select("item_id", "language", "n", "chosen")


SAMPLE_SQL = f"""WITH r AS (SELECT doc_id AS item_id, lang AS language, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents), q AS (SELECT *, n <= CASE language WHEN 'en' THEN 30 WHEN 'de' THEN 15 ELSE 10 END AS chosen FROM r)
SELECT * FROM q ORDER BY chosen DESC, item_id LIMIT {SAMPLE}"""


def round_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and known users per day (round): first seen by a window over distinct pairs, then a roll-up."""
    from pyspark.sql.window import Window

    pairs = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    first = F.min("day").over(Window.partitionBy("user_id"))
    per = pairs.withColumn("new", (F.col("day") == first).cast("long")).groupBy("day").agg(F.sum("new").alias("new_users"), F.count(F.lit(1)).alias("users"))
    return per.select(F.col("day").cast("string").alias("day"), "new_users", "users")


DELTAS_SQL = """WITH p AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), f AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS first FROM p)
SELECT day::VARCHAR AS day, count(*) FILTER (WHERE day = first) AS new_users, count(*) AS users FROM f GROUP BY 1"""


QUERIES = {
    "analytics_categorical": (analytics_categorical, CATEGORICAL_SQL),
    "score_histogram": (score_histogram, HISTOGRAM_SQL),
    "age_distribution": (age_distribution, AGE_SQL),
    "time_buckets": (time_buckets, BUCKETS_SQL),
    "time_trend": (time_trend, TREND_SQL),
    "related_terms": (related_terms, RELATED_SQL),
    "top_hashtags": (top_hashtags, HASHTAG_SQL),
    "engagement_normalised": (engagement_normalised, ENGAGED_SQL),
    "most_engaged": (most_engaged, MOST_SQL),
    "quantiles_by_source": (quantiles_by_source, QUANTILES_SQL),
    "latest_per_key": (latest_per_key, LATEST_SQL),
    "acquisition_funnel": (acquisition_funnel, FUNNEL_SQL),
    "half_even_rounding": (half_even_rounding, ROUNDING_SQL),
    "grouping_sets_slices": (grouping_sets_slices, SLICES_SQL),
    "spam_and_completeness": (spam_and_completeness, COMPLETE_SQL),
    "stratified_sample": (stratified_sample, SAMPLE_SQL),
    "round_deltas": (round_deltas, DELTAS_SQL),
}
