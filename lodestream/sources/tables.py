"""Relations every query starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import numbers, text

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Scanned rows over all cores, where their files are too few to split; a table with a part for each core stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, source, language, title (first line), text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select(F.col("doc_id").alias("item_id"), "source", F.col("lang").alias("language"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")


def content(spark: SparkSession, sf_dir: str, own: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents with url, publication time and metrics.

    The three tables are joined on their ids; each side is projected first, so
    scans read the columns used and nothing else.  own: what is made of the
    documents, with handle and hashtags, ahead of the joins; texts that it
    drops are not shuffled.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), "url")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("ts").alias("published_at"), F.col("value").alias("like_value"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    tags = {"handle": F.concat(F.lit("@"), "source"), "hashtags": text.hashtags(F.col("text"))}
    base = documents(spark, sf_dir)
    base = (own(base.withColumns(tags)) if own else base).join(pages, "item_id", "left").join(events, "item_id", "left")
    url = F.coalesce("url", F.concat(F.lit("https://example.org/doc/"), F.col("item_id").cast("string")))
    return base.withColumns({"canonical_url": url} | ({} if own else tags)).drop("url")


def engagement():
    """Two-metric engagement of the content relation, on the scales of points and comments."""
    return numbers.engagement({"points": F.col("like_value"), "comments": F.col("k")}, numbers.PLATFORM_SCALES["hacker_news"])


#: The content relation in SQL, for oracles.
CONTENT_SQL = """content AS (
  SELECT d.doc_id AS item_id, d.source, d.lang AS language, split_part(d.text, chr(10), 1) AS title, d.text,
    coalesce(p.url, 'https://example.org/doc/' || d.doc_id) AS canonical_url, e.ts AS published_at, e.value AS like_value,
    CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k, '@' || d.source AS handle,
    nullif(list_distinct(regexp_extract_all(' ' || d.text, '[^\\p{L}\\p{N}_]#([\\p{L}\\p{N}_]+)', 1)), []) AS hashtags
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
)"""
NOW_SQL = f"TIMESTAMP '{NOW}'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({norm_sql(x)}, '[\\p{{L}}\\p{{N}}_]+')"


def index_tokens_sql(x: str) -> str:
    return f"regexp_extract_all(strip_accents({norm_sql(x)}), '[\\p{{L}}\\p{{N}}_]+')"


def rounded_sql(x: str, digits: int) -> str:
    """The nearest decimal by the exact value of a double, half to even: what C's printf writes."""
    return f"(CAST(printf('%.{digits}f', CAST(({x}) AS DOUBLE)) AS DOUBLE))"


def share_sql(x: str, scale: int) -> str:
    return f"least(1.0, ln(1 + greatest(0.0, {x})) / ln(1 + {scale}.0))"


ENGAGEMENT_SQL = (
    "CASE WHEN like_value IS NULL AND k IS NULL THEN 0.0 ELSE "
    + rounded_sql(f"100 * (CASE WHEN like_value IS NULL THEN 0.0 ELSE {share_sql('like_value', 45)} END + CASE WHEN k IS NULL THEN 0.0 ELSE {share_sql('CAST(k AS DOUBLE)', 35)} END) / ((like_value IS NOT NULL)::INT + (k IS NOT NULL)::INT)", 2)
    + " END"
)
FRESHNESS_SQL = f"CASE WHEN published_at IS NULL THEN 25.0 ELSE {rounded_sql(f'100 * pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(published_at)) / 3.6e9) / 48.0)', 2)} END"
SPAM_SQL = """least(20.0, CASE WHEN length(trim(text)) < 40 THEN 5.0 ELSE 0.0 END
    + CASE WHEN length(regexp_replace(title || ' ' || text, '[^!]', '', 'g')) >= 5 THEN 6.0 ELSE 0.0 END
    + CASE WHEN length(regexp_replace(title || ' ' || text, '[^\\p{Lu}]', '', 'g')) / greatest(1, length(title || ' ' || text)) > 0.45 THEN 5.0 ELSE 0.0 END
    + CASE WHEN len(regexp_extract_all(canonical_url, 'utm_')) > 1 THEN 2.0 ELSE 0.0 END)"""
