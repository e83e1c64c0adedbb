"""Local memory, analytics snapshots and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import numbers
from lodestream.operators import aggregates as A
from lodestream.operators import memory as M
from lodestream.operators import retrieval as R
from lodestream.plans.retrieval import BM25_PART, PHRASE, PHRASE_SQL, QUERY, TOKENISED_SQL
from lodestream.sources.tables import CONTENT_SQL, ENGAGEMENT_SQL, FRESHNESS_SQL, NOW_SQL, content, engagement, now, rounded_sql, table, tokens_sql

LIMIT = 60


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir)
    return rows.withColumns({"external_id": F.concat(F.lit("doc-"), F.col("item_id").cast("string")), "first_seen_at": now()})


def memory_literal_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.literal_lane(_stored(spark, sf_dir), "@src3", 50)


LITERAL_SQL = "SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id DESC)::INT AS place FROM documents WHERE source = 'src3' ORDER BY doc_id DESC LIMIT 50"


def memory_index_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of each variant (a phrase, and words), and their ordered union."""
    indexed = M.materialise(R.index(content(spark, sf_dir), sorted({*QUERY.distinct, *PHRASE.distinct})), "index")
    return M.ordered_union([M.index_lane(indexed, PHRASE, 40), M.index_lane(indexed, QUERY, 40)], "item_id", LIMIT)


_LANES = f"""lp AS (SELECT item_id, row_number() OVER (ORDER BY bm25 DESC, item_id) AS place FROM pb QUALIFY place <= {{k}}
), kw0 AS (SELECT item_id, {rounded_sql(f'sum({BM25_PART})', 9)} AS bm25 FROM posted JOIN df USING (term), stats WHERE term IN {QUERY.distinct} GROUP BY 1
), kw AS (SELECT item_id, row_number() OVER (ORDER BY bm25 DESC, item_id) AS place FROM kw0 QUALIFY place <= {{k}}"""
# the phrase scores without their rounding, which could tie
_PHRASES = PHRASE_SQL.split("SELECT item_id, (CAST(printf(")[0] + f", pb AS (SELECT item_id, {rounded_sql(BM25_PART, 9)} AS bm25 FROM hit, stats), "


def _union_sql(lanes: list[str], limit: int) -> str:
    rows = " UNION ALL ".join(f"SELECT item_id, {k} AS lane, place FROM {lane}" for k, lane in enumerate(lanes))
    return f"""u AS (SELECT item_id, arg_min(lane, lane * 1000000 + place) AS lane, min(lane * 1000000 + place) AS first FROM ({rows}) GROUP BY 1
), o AS (SELECT item_id, lane::INT AS lane, row_number() OVER (ORDER BY first)::INT AS position FROM u QUALIFY position <= {limit})"""


INDEX_SQL = _PHRASES + _LANES.format(k=40) + "), " + _union_sql(["lp", "kw"], LIMIT) + " SELECT item_id, lane, position FROM o"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discoveries remembered from all documents, those of odd id twelve to a url."""
    rows = content(spark, sf_dir)
    return rows.select(F.col("item_id").alias("record_id"), "title", F.col("text").alias("snippet"), F.when(F.col("item_id") % 2 == 0, F.col("canonical_url")).otherwise(F.concat(F.lit("https://memory.example.org/"), F.expr("item_id div 12").cast("string"))).alias("canonical_url"), F.coalesce(F.col("published_at"), now()).alias("last_seen_at"))


def local_memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.search(_stored(spark, sf_dir), _records(spark, sf_dir), "@src3", [PHRASE, QUERY], now(), LIMIT * 3, historical=True)


MEMORY_SQL = _PHRASES + _LANES.format(k=180) + f"""), lit AS (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS place FROM content WHERE handle = '@src3' QUALIFY place <= 180
), {_union_sql(['lit', 'lp', 'kw'], 180)}, st AS (
  SELECT position, 'content' AS kind, item_id AS key, canonical_url, coalesce(published_at, {NOW_SQL}) < {NOW_SQL} - INTERVAL 30 DAY AS historical FROM o JOIN content USING (item_id)
), rec AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN canonical_url ELSE 'https://memory.example.org/' || (item_id // 12) END AS canonical_url, coalesce(published_at, {NOW_SQL}) AS seen,
    list_concat(title_words, text_words) AS ws FROM tok ORDER BY seen DESC, item_id LIMIT 1000
), hits AS (SELECT * FROM rec WHERE (contains(' ' || array_to_string(ws, ' ') || ' ', ' of the ') OR {' + '.join(f"list_contains(ws, '{w}')::INT" for w in QUERY.distinct)} >= {QUERY.required}) AND canonical_url NOT IN (SELECT canonical_url FROM st)
), one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY seen DESC, item_id) = 1
), dis AS (SELECT ((SELECT count(*) FROM st) + row_number() OVER (ORDER BY seen DESC, item_id))::INT AS position, 'discovery' AS kind, item_id AS key, canonical_url, true AS historical FROM one)
SELECT * FROM (SELECT * FROM st UNION ALL SELECT * FROM dis) WHERE position <= 180"""


def _items(spark: SparkSession, sf_dir: str, query_words: list[str] | None = None) -> DataFrame:
    # words are cut ahead of the joins, so texts are not shuffled
    words = A.topic_words(F.col("title"), F.col("text"), A.snapshot_skip(query_words))
    rows = content(spark, sf_dir, lambda d: d.select("item_id", "language", "handle", words.alias("words")))
    measured = F.col("like_value").isNotNull() | F.col("k").isNotNull()
    platform = F.when(F.col("item_id") % 3 == 0, "reddit").when(F.col("item_id") % 3 == 1, "rss").otherwise("hacker_news")
    score = F.when(F.col("item_id") % 4 != 0, numbers.freshness(F.col("published_at"), now()))
    return rows.select(
        "item_id", platform.alias("source"), F.when(F.col("item_id") % 3 == 0, "social").when(F.col("item_id") % 3 == 1, "news").otherwise("developer_community").alias("category"), "language", "words", "canonical_url",
        "published_at", F.coalesce("published_at", now()).alias("fetched_at"), score.alias("score"), F.when(measured, engagement()).alias("engagement"),
        F.when(measured, numbers.social_reach(platform, engagement(), F.lit(1))).alias("reach"), F.array(F.concat(F.lit("Tag"), (F.col("item_id") % 17).cast("string")), "language").alias("hashtags"), F.array(F.col("handle")).alias("mentions"),
    )


def analytics_snapshot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot(_items(spark, sf_dir, ["the"]), now(), "all", ["the"])


def analytics_snapshot_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot(_items(spark, sf_dir), now(), "7d")


def _snapshot_sql(scope: str, query_words: list[str]) -> str:
    days, step, n = A.SCOPES[scope]
    skip = ", ".join(f"'{w}'" for w in {*A.STOPWORDS, *query_words})
    start = "(SELECT min(published_at) FROM it)" if days is None else f"{NOW_SQL} - INTERVAL {A.STEPS[step] * n} SECOND"
    plain = {"source": "platform_distribution", "category": "category_distribution", "language": "language_distribution"}
    words = f"regexp_replace(title || ' ' || text, '{A.URL}', ' ', 'g')"
    series = ""
    for prefix, where in (("", "true"), ("social_", "category = 'social'"), ("news_", "category = 'news'")):
        series += f""", {prefix}b AS (SELECT least({n - 1}, floor((epoch_us(published_at) - epoch_us(s)) / 1e6 / (greatest(1.0, (epoch_us({NOW_SQL}) - epoch_us(s)) / 1e6) / {n})))::BIGINT AS bucket FROM it, (SELECT {start} AS s) WHERE {where} AND published_at BETWEEN s AND {NOW_SQL}
), {prefix}t AS (SELECT g.bucket, count(b.bucket) AS n_rows FROM range({n}) g(bucket) LEFT JOIN {prefix}b b ON b.bucket = g.bucket GROUP BY 1
), {prefix}m AS (SELECT sum(CASE WHEN bucket < {n // 2} THEN n_rows ELSE 0 END) / {n // 2}.0 AS a, sum(CASE WHEN bucket >= {n // 2} THEN n_rows ELSE 0 END) / {n - n // 2}.0 AS c FROM {prefix}t)"""
    parts = [
        "SELECT 'total_results' AS key, '' AS label, count(*)::DOUBLE AS value FROM it", "SELECT 'unique_results', '', count(DISTINCT canonical_url)::DOUBLE FROM it", "SELECT 'source_count', '', count(DISTINCT source)::DOUBLE FROM it",
        "SELECT 'duplicate_count', '', (count(*) - count(DISTINCT canonical_url))::DOUBLE FROM it", f"SELECT 'average_score', '', {rounded_sql('coalesce(avg(score), 0)', 2)} FROM it", "SELECT 'scored_record_count', '', count(score)::DOUBLE FROM it",
        "SELECT 'platform_diversity', '', count(DISTINCT source) FILTER (WHERE category = 'social')::DOUBLE FROM it", f"SELECT 'average_social_reach', '', {rounded_sql(f'avg(reach)', 2)} FROM it WHERE category = 'social'",
        *(f"SELECT '{k}', {c}, count(*)::DOUBLE FROM it GROUP BY 2" for c, k in plain.items()), "SELECT 'social_source_distribution', source, count(*)::DOUBLE FROM it WHERE category = 'social' GROUP BY 2",
        "SELECT 'score_distribution', (least(80, floor(score / 20) * 20)::BIGINT)::VARCHAR, count(*)::DOUBLE FROM it WHERE score IS NOT NULL GROUP BY 2",
        f"SELECT 'publication_time_distribution', CASE WHEN published_at IS NULL THEN 'unavailable' WHEN published_at >= {NOW_SQL} - INTERVAL 1 DAY THEN 'last_24h' WHEN published_at >= {NOW_SQL} - INTERVAL 7 DAY THEN 'last_7d' WHEN published_at >= {NOW_SQL} - INTERVAL 30 DAY THEN 'last_30d' ELSE 'older' END, count(*)::DOUBLE FROM it GROUP BY 2",
        f"(SELECT 'top_related_terms', term, count(*)::DOUBLE FROM (SELECT unnest(list_distinct({tokens_sql(words)})) AS term FROM it) WHERE length(term) > 2 AND term NOT IN ({skip}) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)",
        "(SELECT 'top_hashtags', mark, count(*)::DOUBLE FROM (SELECT lower(unnest(tags)) AS mark FROM it WHERE category = 'social') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)",
        "(SELECT 'top_mentioned_accounts', handle, count(*)::DOUBLE FROM it WHERE category = 'social' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)",
    ]
    for prefix in ("", "social_", "news_"):
        parts.append(f"SELECT '{prefix}mentions_over_time', bucket::VARCHAR, n_rows::DOUBLE FROM {prefix}t")
        parts.append(f"SELECT '{prefix}trend_percent', '', CASE WHEN a = 0 THEN CASE WHEN c > 0 THEN 100.0 ELSE 0.0 END ELSE {rounded_sql('greatest(-100.0, least(500.0, (c - a) * 100 / a))', 2)} END FROM {prefix}m")
    reach = rounded_sql(f"least(100.0, 0.8 * ({ENGAGEMENT_SQL}))", 2)
    return f"""WITH {CONTENT_SQL}, it0 AS (SELECT *, CASE item_id % 3 WHEN 0 THEN 'social' WHEN 1 THEN 'news' ELSE 'developer_community' END AS category, CASE item_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'rss' ELSE 'hacker_news' END AS platform,
  CASE WHEN item_id % 4 <> 0 THEN {FRESHNESS_SQL} END AS score, CASE WHEN item_id % 3 = 0 AND (like_value IS NOT NULL OR k IS NOT NULL) THEN {reach} END AS reach, ['Tag' || (item_id % 17), language] AS tags FROM content
), it AS (SELECT * EXCLUDE (source, platform), platform AS source FROM it0 {'' if days is None else f'WHERE coalesce(published_at, {NOW_SQL}) >= {NOW_SQL} - INTERVAL {days} DAY'}){series}
""" + " UNION ALL ".join(parts)


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir).select(numbers.freshness(F.col("published_at"), now()).alias("freshness"), engagement().alias("engagement"), "like_value")
    return A.component_stats(rows, ["freshness", "engagement", "like_value"])


STATS_SQL = f"""WITH {CONTENT_SQL}, x AS (SELECT 'freshness' AS component, {FRESHNESS_SQL} AS v FROM content UNION ALL SELECT 'engagement', {ENGAGEMENT_SQL} FROM content UNION ALL SELECT 'like_value', like_value FROM content
), o AS (SELECT component, list_sort(list(v)) AS vs, avg(v) AS mean, stddev_pop(v) AS deviation FROM x WHERE v IS NOT NULL GROUP BY 1)
SELECT component, len(vs) AS n, {rounded_sql('mean', 3)} AS mean, {rounded_sql('deviation', 3)} AS deviation, {', '.join(f"{rounded_sql(f'vs[floor({q} * (len(vs) - 1))::INT + 1]', 3)} AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM o"""


def identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, unique identities and sizes of the groups of equal texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("g"))
    unique = A.unique_identities(rows, F.col("g"), F.col("doc_id"))
    sizes = A.size_distribution(rows.filter("g is not null"), "g")
    counts = unique.select(F.explode(F.array(F.struct(F.lit("rows").alias("what"), F.lit(0).cast("long").alias("size"), F.col("n_rows").alias("n")), F.struct(F.lit("unique").alias("what"), F.lit(0).cast("long").alias("size"), F.col("n_unique").alias("n")))).alias("x")).select("x.*")
    return counts.unionByName(sizes.select(F.lit("groups").alias("what"), "size", F.col("n_groups").alias("n")))


IDENTITY_SQL = """WITH r AS (SELECT doc_id, md5(text) AS g FROM documents)
SELECT 'rows' AS what, 0::BIGINT AS size, count(*) AS n FROM r UNION ALL SELECT 'unique', 0, count(DISTINCT coalesce(g, 'item:' || doc_id)) FROM r
UNION ALL SELECT 'groups', size, count(*) FROM (SELECT count(*) AS size FROM r WHERE g IS NOT NULL GROUP BY g) GROUP BY 2"""


def data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table_counts({t: table(spark, sf_dir, t) for t in ("documents", "pages", "events", "benchmark", "labels", "conversations")})


COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "events", "benchmark", "labels", "conversations"))

QUERIES = {
    "memory_literal_lane": (memory_literal_lane, LITERAL_SQL),
    "memory_index_lanes": (memory_index_lanes, INDEX_SQL),
    "local_memory_search": (local_memory_search, MEMORY_SQL),
    "analytics_snapshot_all": (analytics_snapshot_all, _snapshot_sql("all", ["the"])),
    "analytics_snapshot_7d": (analytics_snapshot_7d, _snapshot_sql("7d", [])),
    "component_stats": (component_stats, STATS_SQL),
    "identity_counts": (identity_counts, IDENTITY_SQL),
    "data_counts": (data_counts, COUNTS_SQL),
}
