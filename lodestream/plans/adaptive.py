"""Queries of the adaptive side: calibration, stop reasons, routing, judgment pools, fusion weights, the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.numbers import rounded
from lodestream.operators import aggregates as A
from lodestream.operators import calibration as C
from lodestream.operators import evidence as E
from lodestream.operators import ordering as O
from lodestream.operators import planning as P
from lodestream.operators import pools as J
from lodestream.operators import vectors as V
from lodestream.plans.vectors import _LISTS_SQL, _RANKED_SQL, _SEMANTIC, EVERY, RRF_SQL, TIES_SQL, _blended, near_tie_diversity, rrf_fusion
from lodestream.sources.scratch import materialise
from lodestream.sources.tables import CONTENT_SQL, content, rounded_sql, table

#: Budgets of the searches that users' events stand for: seconds, requests, rounds.
SECONDS, REQUESTS, ROUNDS = 200, 12, 5


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the rounds of one search, six days a round: what was observed in each."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / (6 * 86400e6)) + 1).cast("int").alias("round"))
    # averages of values: fixed sums over the number of values
    e = O.running_sums(e, ["user_id", "round"], "event_id", {"complete": F.least(F.lit(1.0), F.col("value") / 60), "apart": F.abs(F.col("value") - 30), "total": F.col("value")})
    last, mean = lambda c: O.last(c, "event_id"), lambda c: O.last(c, "event_id") / F.count("value")
    a = e.groupBy("user_id", "round").agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct(F.col("event_id") % 5).alias("sources"), (last("complete") / F.count(F.lit(1))).alias("completeness"),
        (F.count_if(F.col("event_type").isin("view", "click")) / F.count(F.lit(1))).alias("agreement"), mean("apart").alias("disagreement"), (F.max("value") - mean("total")).alias("margin"),
        F.countDistinct("event_type").alias("engines"), F.count_if(F.col("event_type") == "error").alias("errors"), last("total").alias("elapsed"), F.count_if(F.col("value") >= 20).alias("unique"), F.count_if(F.col("value") >= 60).alias("admitted"),
    )
    a = a.withColumns({"unqueried": 5 - F.col("sources"), "single_engine": F.col("engines") == 1, "degraded": F.col("errors") > 2, "hard": F.col("user_id") % 7 == 0, "requests": F.col("candidates")})
    return C.with_previous(a, "user_id")


_ROUNDS_SQL = """e AS (SELECT user_id, event_id, event_type, value, (floor((epoch_us(ts) - 1704067200000000) / (6 * 86400e6)) + 1)::INT AS round FROM events
), a AS (SELECT user_id, round, count(*) AS candidates, count(DISTINCT event_id % 5) AS sources, avg(least(1.0, value / 60)) AS completeness, count(*) FILTER (WHERE event_type IN ('view', 'click')) / count(*) AS agreement,
    avg(abs(value - 30)) AS disagreement, max(value) - avg(value) AS margin, count(DISTINCT event_type) AS engines, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value) AS elapsed, count(*) FILTER (WHERE value >= 20) AS uniq, count(*) FILTER (WHERE value >= 60) AS admitted FROM e GROUP BY 1, 2
), b AS (SELECT *, 5 - sources AS unqueried, lag(uniq) OVER (PARTITION BY user_id ORDER BY round) AS bu, lag(admitted) OVER (PARTITION BY user_id ORDER BY round) AS ba FROM a
), c AS (SELECT *, coalesce(round > 1 AND bu IS NOT NULL AND uniq / greatest(1, bu) < 0.15 AND admitted / greatest(1, CASE WHEN coalesce(ba, 0) <> 0 THEN ba ELSE bu END) < 0.15, false) AS sat FROM b)"""


def calibrated_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated risk, its level, and the saturation rule's decision, of every round of every search."""
    rows = _rounds(spark, sf_dir).withColumn("risk", C.risk()).withColumn("level", C.level(F.col("risk")))
    decision = C.saturation(F.col("level"), SECONDS, REQUESTS, ROUNDS)
    return rows.select("user_id", "round", "risk", "level", C.saturated().alias("saturated"), decision.alias("decision"))


_BANDS = " + ".join("CASE " + " ".join(f"WHEN {name} {kind} {bound} THEN {points}" for bound, points in bounds) + " ELSE 0 END" for name, (kind, bounds) in C.RISKS.items())
SATURATION_SQL = f"""WITH {_ROUNDS_SQL}, p AS (SELECT *, {_BANDS} + (engines = 1)::INT + (errors > 2)::INT + (user_id % 7 = 0 AND unqueried > 0)::INT AS r0 FROM c
), q AS (SELECT *, greatest(0, r0 - CASE WHEN sat THEN 2 ELSE 0 END) AS r1 FROM p), r AS (SELECT *, greatest(0, r1 - CASE WHEN sources >= 4 AND candidates >= 15 AND completeness >= 0.7 AND agreement >= 0.7 THEN 2 ELSE 0 END) AS r2 FROM q
), s AS (SELECT *, greatest(0, r2 - CASE WHEN unqueried = 0 THEN 1 ELSE 0 END)::INT AS risk FROM r), t AS (SELECT *, CASE WHEN risk <= 1 THEN 'LOW' WHEN risk <= 4 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s)
SELECT user_id, round, risk, level, sat AS saturated, CASE WHEN elapsed >= {SECONDS} THEN 'TIME_BUDGET' WHEN candidates >= {REQUESTS} THEN 'REQUEST_BUDGET' WHEN round >= {ROUNDS} THEN 'MAX_ROUNDS' WHEN unqueried = 0 THEN 'SOURCE_EXHAUSTION' WHEN sat THEN 'LOW_MARGINAL_GAIN'
  WHEN level <> 'LOW' THEN 'UNCERTAINTY_WITH_AVAILABLE_COVERAGE' ELSE 'SATISFIED' END AS decision FROM t"""


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production rule's reason to stop, all eight of them, for every round of every search; null goes on."""
    rows = _rounds(spark, sf_dir).withColumn("level", F.when(F.col("completeness") > 0.55, "LOW").otherwise("HIGH"))
    gained = P.gain(F.col("unique"), F.col("admitted"), F.lit(0), F.lit(0), F.lit(0), F.col("requests"), F.col("elapsed") * 1000)
    reason = P.stop_reason(F.col("level"), gained, F.col("unique"), 11, F.col("round"), ROUNDS + 1, F.col("unqueried"), F.col("elapsed"), 600.0, F.col("requests"), 16, F.col("errors") - 1, F.col("hard"))
    return rows.select("user_id", "round", "level", rounded(gained, 6).alias("gain"), reason.alias("stop"))


STOPS_SQL = f"""WITH {_ROUNDS_SQL}, g AS (SELECT *, CASE WHEN completeness > 0.55 THEN 'LOW' ELSE 'HIGH' END AS level, ln(1 + uniq + 1.5 * admitted) / greatest(1.0, candidates + elapsed * 1000 / 5000.0) AS gain FROM c)
SELECT user_id, round, level, {rounded_sql('gain', 6)} AS gain, CASE WHEN elapsed >= 600 THEN 'TIME_BUDGET' WHEN candidates >= 16 AND unqueried > 0 THEN 'REQUEST_BUDGET' WHEN uniq >= 11 AND user_id % 7 <> 0 THEN 'USER_LIMIT' WHEN level = 'LOW' AND uniq >= 10 AND user_id % 7 <> 0 THEN 'SATISFIED'
  WHEN round > 1 AND gain < 0.12 THEN 'LOW_MARGINAL_GAIN' WHEN unqueried > 0 AND round < {ROUNDS + 1} THEN NULL WHEN round >= {ROUNDS + 1} THEN 'MAX_ROUNDS' WHEN errors = 1 THEN 'NO_AVAILABLE_SOURCES' ELSE 'SOURCE_EXHAUSTION' END AS stop FROM g"""


def shadow_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user as a query, the plan of sources that learned utility would have made, beside the plan in use."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string")).alias("source"), "event_type", "value", "event_id")
    e = O.running_sums(e, ["user_id", "source"], "event_id", {"total": F.col("value")})
    a = e.groupBy("user_id", "source").agg(O.last("total", "event_id").alias("sum"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.count_if(F.col("event_type") == "error").alias("errors"))
    learned = F.when(F.col("n") > 1, rounded((F.col("sum") / F.col("n") - 60) / 8, 3))
    rows = a.select("user_id", "source", rounded(40 + F.col("top") / 5, 3).alias("total"), F.least(F.lit(100.0), F.col("top")).alias("capability"), (F.col("errors") < 3).alias("available"), learned.alias("adjustment"), F.when(F.col("n") > 1, F.col("n")).alias("observations"))
    return C.shadow_route(rows, "user_id")


ROUTES_SQL = f"""WITH a AS (SELECT user_id, 's' || (event_id % 9) AS source, sum(value) AS s, count(*) AS n, max(value) AS top, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2
), b AS (SELECT user_id, source, {rounded_sql('40 + top / 5', 3)} AS total, least(100.0, top) AS capability, errors < 3 AS available, CASE WHEN n > 1 THEN {rounded_sql('(s / n - 60) / 8', 3)} END AS adjustment, CASE WHEN n > 1 THEN n END AS observations FROM a
), c AS (SELECT *, total + coalesce(adjustment, 0.0) AS expected FROM b
), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, source) AS place, row_number() OVER (PARTITION BY user_id ORDER BY expected DESC, source) AS shadow_place, max(expected) OVER (PARTITION BY user_id) AS best FROM c
), r AS (SELECT *, CASE WHEN NOT available THEN 'unavailable' WHEN shadow_place <= 4 OR capability >= 90 THEN 'protected' WHEN coalesce(observations, 0) < 5 THEN 'insufficient evidence' WHEN coalesce(adjustment, 0.0) > -1.5 OR expected >= best - 18 THEN 'competitive' ELSE 'low yield' END AS reason FROM d)
SELECT user_id, source, place::INT AS place, shadow_place::INT AS shadow_place, {rounded_sql('expected', 3)} AS expected, CASE WHEN reason IN ('unavailable', 'low yield') THEN 'DEFER' ELSE 'SELECT' END AS recommendation, reason FROM r"""


def judgment_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rankings of each query disagree on most, five items a query."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = materialise(V.top_k(queries.select("query_id", "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"), 100), "near")
    own = near.filter("rank <= 10").select("query_id", "item_id", "rank")
    fused = rrf_fusion(spark, sf_dir).select("query_id", "item_id", F.col("place").alias("rank"))
    diverse = near_tie_diversity(spark, sf_dir, near).select("query_id", F.col("key").alias("item_id"), F.col("position").alias("rank"))
    unsure = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.col("label") % 3 + 1).cast("int"))
    asked = queries.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 40).alias("text")), "query_id", "left")
    asked = asked.select("query_id", F.when(F.col("label") == 4, F.concat(F.lit("خبر "), "text")).otherwise(F.col("text")).alias("query"), unsure.alias("uncertainty"))
    return J.pool({"production": own, "fusion": fused, "diversity": diverse}, asked, quota=5)


POOL_SQL = f"""WITH {_RANKED_SQL}, l AS (SELECT query_id, item_id, 'p' AS list, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, item_id, 'f', place FROM ({RRF_SQL}) WHERE place <= 10 UNION ALL SELECT query_id, key, 'd', position FROM ({TIES_SQL}) WHERE position <= 10
), w AS (SELECT query_id, item_id, min(rank) FILTER (WHERE list = 'p') AS p, min(rank) FILTER (WHERE list = 'f') AS f, min(rank) FILTER (WHERE list = 'd') AS d, CASE WHEN count(*) > 1 THEN max(rank) - min(rank) ELSE 10 END AS apart, substr(sha256(query_id || ':' || item_id), 1, 20) AS queue_id FROM l GROUP BY 1, 2
), v AS (SELECT w.*, apart + CASE WHEN label = 4 AND doc_id IS NOT NULL THEN 10 ELSE 0 END + CASE label % 3 WHEN 2 THEN 8 WHEN 1 THEN 4 ELSE 0 END AS priority FROM w JOIN embeddings ON vec_id = query_id LEFT JOIN documents ON doc_id = query_id)
SELECT query_id, item_id, p::INT AS production_rank, f::INT AS fusion_rank, d::INT AS diversity_rank, queue_id, priority::INT AS priority, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, queue_id)::INT AS position FROM v QUALIFY position <= 5"""


def fusion_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every fusion weight by the language of the query, and the weight to take."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    asked = e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    queries = asked.join(sizes, F.col("wanted") == F.col("label")).join(docs, "query_id", "left").select("query_id", "wanted", F.coalesce("lang", F.lit("none")).alias("query_class"), (F.col("n") - 1).alias("n_relevant"))
    lexical = F.coalesce("lexical", F.lit(0.0))
    rows = _blended(spark, sf_dir, J.GRID, 6, highest_id=True).select("query_id", "item_id", lexical.alias("lexical"), F.coalesce(V.semantic_score(F.col("similarity")), lexical).alias("semantic"))
    rows = rows.join(e.select(F.col("vec_id").alias("item_id"), "label"), "item_id", "left").join(queries.select("query_id", "wanted"), "query_id").withColumn("hit", F.coalesce((F.col("label") == F.col("wanted")).cast("int"), F.lit(0)))
    return J.fusion_weights(rows, queries.drop("wanted"))


_USED = f"max(CASE WHEN weight = {J.IN_USE} THEN {{}} END) OVER (PARTITION BY query_class)"
GRID_SQL = f"""{_LISTS_SQL}, s AS (SELECT query_id, item_id, coalesce(lexical, 0.0) AS lexical, coalesce({_SEMANTIC}, lexical, 0.0) AS semantic FROM lists
), g AS (SELECT s.*, w AS weight, {rounded_sql('w * lexical + (1 - w) * semantic', 6)} AS score, coalesce(i.label = q.label, false) AS hit FROM s CROSS JOIN (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in J.GRID)}]) AS w) JOIN embeddings q ON q.vec_id = s.query_id LEFT JOIN embeddings i ON i.vec_id = s.item_id
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, weight ORDER BY score DESC, lexical DESC, item_id DESC) AS rank FROM g QUALIFY rank <= 10
), n AS (SELECT q.vec_id AS query_id, coalesce(lang, 'none') AS query_class, (SELECT count(*) - 1 FROM embeddings i WHERE i.label = q.label) AS m FROM embeddings q LEFT JOIN documents ON doc_id = q.vec_id WHERE q.vec_id % {EVERY} = 0
), c AS (SELECT query_id, weight, sum(hit::INT / log2(rank + 1.0)) AS gain, count(*) FILTER (WHERE hit AND rank <= 5) / 5 AS p FROM t GROUP BY 1, 2
), o AS (SELECT query_class, weight, {rounded_sql('avg(CASE WHEN m > 0 THEN gain / list_sum(list_transform(range(1, least(10, m) + 1), lambda r: 1 / log2(r + 1.0))) ELSE 0 END)', 6)} AS ndcg, {rounded_sql('avg(p)', 6)} AS precision FROM c JOIN n USING (query_id) GROUP BY 1, 2
), b AS (SELECT *, {_USED.format('ndcg')} AS un, {_USED.format('precision')} AS up, row_number() OVER (PARTITION BY query_class ORDER BY ndcg DESC, precision DESC, {rounded_sql(f'abs(weight - {J.IN_USE})', 6)}, weight) AS r FROM o
), k AS (SELECT query_class, CASE WHEN ndcg >= {rounded_sql(f'un + {J.GUARD}', 6)} AND precision >= up THEN weight ELSE {J.IN_USE} END AS take FROM b WHERE r = 1)
SELECT query_class, weight, ndcg, precision, weight = take AS chosen FROM o JOIN k USING (query_class)"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results of a search in their language, three of them one content."""
    rows = content(spark, sf_dir)
    said = F.create_map(F.lit("language"), F.col("language"), F.lit("chars"), F.length("text").cast("string"), F.concat(F.lit("from_"), "source"), F.col("item_id").cast("string"))
    return rows.select(F.col("item_id").alias("seq"), F.concat(F.lit("News "), F.upper("language")).alias("query"), F.expr("item_id div 3").alias("content_id"), F.col("canonical_url").alias("url"), "source", "handle", "hashtags", F.when(F.col("k") < 30, F.concat(F.lit("story"), (F.col("k") % 8).cast("string"))).alias("story"), F.expr("item_id div 100").alias("session"), said.alias("properties"), "language")


def _shown(properties: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda x: F.concat_ws("=", x.key, x.value)), ",").alias(properties)


def evidence_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of yesterday's graph (English results) with those of today's folded in."""
    seen = _observed(spark, sf_dir)
    old, new = (E.observe(seen.filter(test).drop("language"))[0] for test in ("language = 'en'", "language <> 'en'"))
    return E.upsert_nodes(E.fold_nodes(old), new).select("kind", "key", "label", _shown("properties"), "first_seen", "last_seen")


def evidence_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of yesterday's graph (English results) with those of today's folded in."""
    seen = _observed(spark, sf_dir)
    old, new = (E.observe(seen.filter(test).drop("language"))[1] for test in ("language = 'en'", "language <> 'en'"))
    return E.upsert_edges(E.fold_edges(old), new).select("from_kind", "from_key", "relation", "to_kind", "to_key", "support", _shown("properties"), "first_seen", "last_seen")


_SEEN_SQL = f"""WITH {CONTENT_SQL}, o AS (SELECT item_id AS seq, 'news ' || lower(language) AS qk, 'News ' || upper(language) AS ql, (item_id // 3)::VARCHAR AS ck, substr(trim(canonical_url), 1, 500) AS url, sha256(canonical_url) AS uk, source, lower(handle) AS hk, handle, hashtags[1:20] AS tags,
  CASE WHEN k < 30 THEN 'story' || (k % 8) END AS story, (item_id // 100)::VARCHAR AS session, language, length(text)::VARCHAR AS chars FROM content)"""
NODES_SQL = f"""{_SEEN_SQL}, n AS (SELECT 'query' AS kind, qk AS key, ql AS label, seq FROM o UNION ALL SELECT 'content', ck, ck, seq FROM o UNION ALL SELECT 'canonical_url', uk, url, seq FROM o UNION ALL SELECT 'source', source, source, seq FROM o UNION ALL SELECT 'author_handle', hk, handle, seq FROM o
  UNION ALL SELECT 'story', story, story, seq FROM o WHERE story IS NOT NULL UNION ALL SELECT 'hashtag', lower(t), t, seq FROM (SELECT unnest(tags) AS t, seq FROM o)
), p AS (SELECT ck, k, arg_max(v, seq) AS v FROM (SELECT ck, seq, 'language' AS k, language AS v FROM o UNION ALL SELECT ck, seq, 'chars', chars FROM o UNION ALL SELECT ck, seq, 'from_' || source, seq::VARCHAR FROM o) GROUP BY 1, 2
), m AS (SELECT 'content' AS kind, ck AS key, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM p GROUP BY 2
), g AS (SELECT kind, key, arg_min(label, {{'s': seq, 'l': label}}) AS label, min(seq) AS first_seen, max(seq) AS last_seen FROM n GROUP BY 1, 2)
SELECT kind, key, label, coalesce(properties, '') AS properties, first_seen, last_seen FROM g LEFT JOIN m USING (kind, key)"""
EDGES_SQL = f"""{_SEEN_SQL}, e AS (SELECT 'query' AS from_kind, qk AS from_key, 'discovered_by' AS relation, 'content' AS to_kind, ck AS to_key, 'session_id=' || session AS properties, seq FROM o UNION ALL SELECT 'content', ck, 'links_to', 'canonical_url', uk, '', seq FROM o UNION ALL SELECT 'content', ck, 'published_on', 'source', source, '', seq FROM o
  UNION ALL SELECT 'content', ck, 'mentions_author', 'author_handle', hk, '', seq FROM o UNION ALL SELECT 'content', ck, 'same_story', 'story', story, 'algorithmic=true', seq FROM o WHERE story IS NOT NULL UNION ALL SELECT 'content', ck, 'mentions', 'hashtag', lower(t), '', seq FROM (SELECT unnest(tags) AS t, ck, seq FROM o))
SELECT from_kind, from_key, relation, to_kind, to_key, count(*) AS support, arg_max(properties, seq) AS properties, min(seq) AS first_seen, max(seq) AS last_seen FROM e GROUP BY 1, 2, 3, 4, 5"""


_ENGINE = {"engine": "concat('e', event_id % 3)", "platform": "concat('p', user_id % 4)", "query_class": "event_type"}


def engine_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return A.engine_utility(e.selectExpr(*(f"{v} AS {k}" for k, v in _ENGINE.items()), "value < 80 AS available", "event_id % 20 AS canonical_yield", "value * 10 AS latency_ms"))


ENGINES_SQL = f"SELECT {', '.join(f'{v} AS {k}' for k, v in _ENGINE.items())}, count(*) AS requests, count(*) FILTER (WHERE value < 80) AS available, sum(event_id % 20)::BIGINT AS canonical_yield, {rounded_sql('avg(value * 10)', 2)} AS latency_ms FROM events GROUP BY 1, 2, 3"


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as searches, the rounds of each in its diagnostics."""
    r = _rounds(spark, sf_dir).withColumn("risk", C.risk()).select("user_id", "round", "candidates", "admitted", "elapsed", C.level(F.col("risk")).alias("level"))
    a = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("round", "level"))).alias("rounds"), F.sum("candidates").alias("requests_used"), F.sum(F.when(F.col("round") > 3, F.col("admitted")).otherwise(0)).alias("n_results"), F.sum("elapsed").alias("duration_ms"))
    stop = F.when(F.col("user_id") % 4 > 0, F.element_at(F.array(F.lit("SATISFIED"), F.lit("MAX_ROUNDS"), F.lit("TIME_BUDGET")), (F.col("user_id") % 4).cast("int")))
    rows = a.select(F.element_at(F.array(F.lit("ar"), F.lit("en")), (F.col("user_id") % 2 + 1).cast("int")).alias("language"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("query_class"), "n_results", "duration_ms", F.to_json(F.struct(stop.alias("stop_reason"), "requests_used", F.filter("rounds", lambda x: x["round"] > 1).alias("rounds"))).alias("diagnostics"))
    return A.quality_summary(rows)


QUALITY_SQL = f"""WITH {_ROUNDS_SQL}, p AS (SELECT *, {_BANDS} + (engines = 1)::INT + (errors > 2)::INT + (user_id % 7 = 0 AND unqueried > 0)::INT AS r0 FROM c
), q AS (SELECT *, greatest(0, r0 - CASE WHEN sat THEN 2 ELSE 0 END) AS r1 FROM p), r AS (SELECT *, greatest(0, r1 - CASE WHEN sources >= 4 AND candidates >= 15 AND completeness >= 0.7 AND agreement >= 0.7 THEN 2 ELSE 0 END) AS r2 FROM q
), s AS (SELECT *, greatest(0, r2 - CASE WHEN unqueried = 0 THEN 1 ELSE 0 END)::INT AS risk FROM r), t AS (SELECT *, CASE WHEN risk <= 1 THEN 'LOW' WHEN risk <= 4 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s
), u AS (SELECT user_id, count(*) FILTER (WHERE round > 1) AS rounds, arg_max(level, round) FILTER (WHERE round > 1) AS level, sum(candidates) AS requests, sum(CASE WHEN round > 3 THEN admitted ELSE 0 END) AS results, sum(elapsed) AS dur, (['ar', 'en'])[user_id % 2 + 1] AS language, 'c' || (user_id % 3) AS class, CASE WHEN user_id % 4 > 0 THEN (['SATISFIED', 'MAX_ROUNDS', 'TIME_BUDGET'])[user_id % 4] END AS stop FROM t GROUP BY user_id)
SELECT 'searches' AS what, '' AS name, count(*)::DOUBLE AS value FROM u UNION ALL SELECT 'zero_results', '', count(*) FILTER (WHERE results = 0) FROM u UNION ALL SELECT 'zero_result_rate', '', {rounded_sql('count(*) FILTER (WHERE results = 0) / count(*)', 4)} FROM u UNION ALL SELECT 'average_rounds', '', {rounded_sql('avg(rounds)', 2)} FROM u
UNION ALL SELECT 'average_requests', '', {rounded_sql('avg(requests)', 2)} FROM u UNION ALL SELECT 'average_latency_ms', '', {rounded_sql('avg(dur)', 2)} FROM u UNION ALL SELECT 'language', language, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'query_class', class, count(*) FROM u GROUP BY 2
UNION ALL SELECT 'stop_reason', stop, count(*) FROM u WHERE stop IS NOT NULL GROUP BY 2 UNION ALL SELECT 'uncertainty', level, count(*) FROM u WHERE level IS NOT NULL GROUP BY 2"""

_HEALTH = "CASE user_id % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'timeout' WHEN 3 THEN 'restricted' ELSE 'odd' END"


def connector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as connectors: how many are in each state."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    return A.state_counts(e.selectExpr("top > 120 AS enabled", "n % 6 <> 0 AS configured", f"{_HEALTH} AS health"))


STATES_SQL = f"""WITH c AS (SELECT user_id, max(value) > 120 AS enabled, count(*) % 6 <> 0 AS configured, {_HEALTH} AS health FROM events GROUP BY user_id)
SELECT CASE WHEN NOT enabled THEN 'disabled' WHEN NOT configured THEN 'unconfigured' WHEN health IN ('degraded', 'timeout') THEN 'degraded' WHEN health = 'restricted' THEN 'restricted' ELSE 'active' END AS state, count(*) AS n FROM c GROUP BY 1"""


QUERIES = {
    "engine_utility": (engine_utility, ENGINES_SQL),
    "quality_summary": (quality_summary, QUALITY_SQL),
    "connector_states": (connector_states, STATES_SQL),
    "calibrated_saturation": (calibrated_saturation, SATURATION_SQL),
    "stop_reasons": (stop_reasons, STOPS_SQL),
    "shadow_routes": (shadow_routes, ROUTES_SQL),
    "judgment_pool": (judgment_pool, POOL_SQL),
    "fusion_weight_grid": (fusion_weight_grid, GRID_SQL),
    "evidence_graph_nodes": (evidence_graph_nodes, NODES_SQL),
    "evidence_graph_edges": (evidence_graph_edges, EDGES_SQL),
}
