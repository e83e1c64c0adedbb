"""Coverage, discoveries, lattices, expansion and aliases: searches made from the events and documents.

What a search is made of is written once, as expressions that Spark and the
oracles share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.functions.numbers import rounded
from lodestream.operators import coverage as C
from lodestream.operators import discovery as D
from lodestream.operators import lattice as L
from lodestream.sources.tables import documents, rounded_sql, table

SEARCH = "user_id % 40"
SOURCE = "CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'rss' WHEN 2 THEN 'gdelt' WHEN 3 THEN 'reddit' WHEN 4 THEN 'mastodon' ELSE 'github' END"
ERROR = "CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'http_403' WHEN event_id % 17 = 0 THEN 'odd' WHEN event_id % 19 = 0 THEN 'unconfigured' END"
STATE = "CASE (search * 7 + length(source)) % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unconfigured' WHEN 3 THEN 'timeout' ELSE 'odd' END"
SELECTED = "(search + length(source)) % 3 <> 0"
#: Which events stand for the runs of a source, and for what a search shows in the end.
RUN, FINAL = "event_type = 'signup' AND value > 100", "event_type = 'purchase'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", "ts", f"{SEARCH} AS search", f"{SOURCE} AS source", f"{ERROR} AS error")


_EVENTS_SQL = f"ev AS (SELECT event_id, user_id, event_type, value, ts, {SEARCH} AS search, {SOURCE} AS source, {ERROR} AS error FROM events)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    sources = e.select("search", "source").distinct().selectExpr("search", "source", f"{STATE} AS state", f"{SELECTED} AS selected")
    runs = e.filter(RUN).groupBy("search", "source").agg(F.max("event_id").alias("event_id")).join(e.select("event_id", "error"), "event_id")
    runs = runs.selectExpr("search", "source", "error", "event_id % 4 AS matched", "event_id % 3 AS admitted")
    return C.gap_reasons(sources, runs, e.filter(FINAL), "search", web_enabled=False)


_REASON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REASONS.items())
_GAPS_SQL = f"""WITH {_EVENTS_SQL}, src AS (SELECT *, {STATE} AS state, {SELECTED} AS selected FROM (SELECT DISTINCT search, source FROM ev)
), ru AS (SELECT search, source, event_id % 4 AS matched, event_id % 3 AS admitted, coalesce(error, '') AS error FROM ev WHERE event_id IN (SELECT max(event_id) FROM ev WHERE {RUN} GROUP BY search, source)
), fi AS (SELECT search, source, count(*) AS final FROM ev WHERE {FINAL} GROUP BY 1, 2
), g AS (SELECT src.search, src.source, selected, ru.search IS NOT NULL AS executed, coalesce(final, 0) > 0 AS contributed, coalesce(matched, 0) AS matched, coalesce(admitted, 0) AS admitted, coalesce(final, 0) AS final,
  CASE WHEN ru.search IS NOT NULL AND error <> '' THEN CASE error {_REASON} ELSE 'FAILED' END WHEN ru.search IS NOT NULL AND matched = 0 THEN 'NO_MATCHES'
    WHEN NOT selected THEN CASE WHEN src.source IN ('x', 'threads', 'reddit') THEN 'WEB_DISCOVERY_DISABLED' ELSE CASE state {_REASON} ELSE 'NOT_SELECTED' END END WHEN ru.search IS NULL THEN 'NOT_SELECTED' END AS reason,
  ru.search IS NOT NULL AND error <> '' AS failed
  FROM src LEFT JOIN ru USING (search, source) LEFT JOIN fi USING (search, source))"""


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).drop("failed")


def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage_status(_gaps(spark, sf_dir), "search")


STATUS_SQL = _GAPS_SQL + " SELECT search, count(reason) AS n_gaps, sum(contributed::INT)::BIGINT AS n_contributed, CASE WHEN bool_or(failed) THEN 'PARTIAL' WHEN count(reason) > 0 THEN 'LIMITED' ELSE 'COMPLETE_ATTEMPT' END AS status FROM g GROUP BY 1"
PATH = "CASE event_id % 4 WHEN 0 THEN 'LOCAL_MEMORY' WHEN 1 THEN 'HISTORICAL_INDEX' ELSE 'API' END"


def coverage_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    funnel = e.selectExpr("search", f"{PATH} AS path", "event_id % 3 AS admitted")
    final = e.filter(FINAL).selectExpr("search", f"array({PATH}, CASE WHEN event_id % 3 = 0 THEN 'LOCAL_MEMORY' ELSE 'WEB_INDEX' END) AS paths", "event_id % 7 = 0 AS historical")
    return C.lanes(funnel, final, "search")


LANES_SQL = f"""WITH {_EVENTS_SQL}, f AS (SELECT search, CASE {PATH} WHEN 'LOCAL_MEMORY' THEN 'LOCAL_MEMORY' WHEN 'HISTORICAL_INDEX' THEN 'HISTORICAL' ELSE 'LIVE' END AS lane, sum(event_id % 3)::BIGINT AS candidates FROM ev GROUP BY 1, 2
), p AS (SELECT search, {PATH} AS a, CASE WHEN event_id % 3 = 0 THEN 'LOCAL_MEMORY' ELSE 'WEB_INDEX' END AS b, event_id % 7 = 0 AS h FROM ev WHERE {FINAL}
), r AS (SELECT search, 'LIVE' AS lane FROM p WHERE a = 'API' OR b = 'WEB_INDEX' UNION ALL SELECT search, 'LOCAL_MEMORY' FROM p WHERE a = 'LOCAL_MEMORY' OR b = 'LOCAL_MEMORY' UNION ALL SELECT search, 'HISTORICAL' FROM p WHERE a = 'HISTORICAL_INDEX' OR h
), n AS (SELECT search, lane, count(*) AS final FROM r GROUP BY 1, 2)
SELECT search, lane, coalesce(candidates, 0) AS candidates, coalesce(final, 0) AS final FROM f FULL JOIN n USING (search, lane)"""

_SEARCHED = {"results": "CASE WHEN user_id % 4 = 0 THEN 2 ELSE 0 END", "planned": "user_id % 3", "time_range": "CASE user_id % 5 WHEN 0 THEN '24h' WHEN 1 THEN '7d' ELSE 'all' END"}
#: The runs of a search: only failures in every second, and for every third of those only sources of the web's index, unconfigured.
_RAN = {
    "source": "CASE WHEN user_id % 6 = 1 THEN CASE event_id % 2 WHEN 0 THEN 'x' ELSE 'reddit' END ELSE 's' || (event_id % 3) END",
    "error": "CASE WHEN user_id % 6 = 1 THEN 'unconfigured' WHEN user_id % 2 = 1 THEN CASE WHEN user_id % 5 = 2 AND value > 60 THEN 'odd' ELSE 'timeout' END WHEN value > 90 THEN 'rate_limited' END",
    "items": "CASE WHEN user_id % 2 = 1 OR value > 90 THEN 0 ELSE event_id % 2 END", "query_matches": "event_id % 5", "time_eligible": "CASE WHEN user_id % 2 = 0 AND user_id % 5 = 0 THEN event_id % 4 ELSE event_id % 5 END",
}


def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each user's search, its events being the runs of its sources, ended with what it has."""
    e = table(spark, sf_dir, "events")
    searches = e.select("user_id").distinct().selectExpr("user_id", *(f"{v} AS {k}" for k, v in _SEARCHED.items()))
    return C.outcome(searches, e.selectExpr("user_id", *(f"{v} AS {k}" for k, v in _RAN.items())), "user_id")


OUTCOMES_SQL = f"""WITH s AS (SELECT user_id, {', '.join(f'{v} AS {k}' for k, v in _SEARCHED.items())} FROM (SELECT DISTINCT user_id FROM events)
), r AS (SELECT user_id, {', '.join(f'{v} AS {k}' for k, v in _RAN.items())} FROM events), f AS (SELECT *, error IS NOT NULL AND items = 0 AS failed FROM r
), a AS (SELECT user_id, count(DISTINCT source) AS n, count(DISTINCT source) FILTER (WHERE failed) AS bad, count(DISTINCT source) FILTER (WHERE failed AND source NOT IN ('x', 'threads', 'reddit')) AS elsewhere, bool_or(query_matches > time_eligible) AS filtered, bool_and(coalesce(error IN ('unconfigured', 'configuration_missing'), false)) AS unset FROM f GROUP BY 1
), x AS (SELECT user_id, bool_and(ext) AS ext FROM (SELECT user_id, source, bool_or(failed) AS failed, bool_or(coalesce(error IN ({', '.join(f"'{e}'" for e in C.EXTERNAL)}), false)) AS ext FROM f GROUP BY 1, 2) WHERE failed GROUP BY 1
), o AS (SELECT user_id, bad, ext, CASE WHEN results > 0 THEN 'RESULTS_AVAILABLE' WHEN planned = 0 OR n IS NULL THEN 'NO_CAPABLE_SOURCE' WHEN time_range <> 'all' AND filtered THEN 'NO_MATCHES_IN_TIME_RANGE' WHEN bad > 0 AND bad = n AND elsewhere = 0 AND unset THEN 'WEB_DISCOVERY_BLOCKED' WHEN bad > 0 AND bad = n THEN 'ALL_SELECTED_SOURCES_FAILED' ELSE 'NO_MATCHES' END AS reason FROM s LEFT JOIN a USING (user_id) LEFT JOIN x USING (user_id))
SELECT user_id, reason, CASE WHEN reason = 'ALL_SELECTED_SOURCES_FAILED' THEN CASE WHEN ext THEN 'EXTERNAL_LIMIT' ELSE 'SOURCE_UNAVAILABLE' END END AS cause, coalesce(bad, 0) AS n_failed FROM o"""


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).selectExpr("source", "event_id", "value AS latency_ms", "error", "event_id % 2 AS items")
    return C.health_roll_up(runs, "source", ["event_id"]).withColumn("mean_latency", rounded(F.col("mean_latency"), 4))


_HEALTH = "CASE WHEN error IS NULL THEN 'healthy' WHEN event_id % 2 > 0 THEN 'degraded' ELSE CASE error " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.HEALTH.items()) + " ELSE 'degraded' END END"
HEALTH_SQL = f"""WITH {_EVENTS_SQL}, s AS (SELECT *, {_HEALTH} AS state FROM ev), b AS (SELECT *, lag(state) OVER (PARTITION BY source ORDER BY event_id) AS before FROM s)
SELECT source, count(*) AS n_runs, {rounded_sql('avg(value)', 4)} AS mean_latency, count(error) AS failures, sum((state = 'healthy' AND before IS NOT NULL AND before NOT IN ('healthy', 'unconfigured'))::INT)::BIGINT AS recoveries,
  arg_max(state, event_id) AS state, arg_max_null(error, event_id) AS last_error FROM b GROUP BY 1"""

FOUND = {
    "key": "'https://d.example.org/' || (event_id % 300)", "seq": "event_id", "title": "CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || event_id END", "snippet": "CASE WHEN event_id % 4 <> 0 THEN 's' || event_id END", "engine": "'e' || (event_id % 3)",
    "variant": "'v' || (user_id % 4)", "round": "1 + event_id % 2", "rank": "1 + event_id % 20", "engine_weight": "0.5 + (event_id % 4) * 0.6", "confidence": "0.7 + (event_id % 3) * 0.2",
}
_FOUND_SQL = "fo AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FOUND.items()) + " FROM events)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"round": "INT", "rank": "INT", "engine_weight": "DOUBLE", "confidence": "DOUBLE"}
    return table(spark, sf_dir, "events").selectExpr(*(f"CAST({v} AS {kinds[k]}) AS {k}" if k in kinds else f"{v} AS {k}" for k, v in FOUND.items()))


def discovery_merged_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.merged(_found(spark, sf_dir))
    rows = rows.withColumn("completeness", D.completeness(F.col("title"), F.col("snippet"), F.when(F.col("support") > 9, F.lit("many"))))
    return D.ranked(rows, 50).select("key", "title", "snippet", "support", F.array_join("engines", ",").alias("engines"), F.array_join("variants", ",").alias("variants"), F.array_join(F.transform("rounds", lambda r: r.cast("string")), ",").alias("rounds"), "score", "completeness")


MERGED_SQL = f"""WITH {_FOUND_SQL}, r1 AS (SELECT key, engine, variant, round, arg_min(greatest(0.0, least(2.0, engine_weight)) * greatest(0.0, least(1.0, confidence)), rank * 1000.0 + greatest(0.0, least(2.0, engine_weight)) * greatest(0.0, least(1.0, confidence))) AS w, min(rank) AS rank FROM fo GROUP BY 1, 2, 3, 4
), sc AS (SELECT key, {rounded_sql('sum(w / (60 + rank))', 8)} AS score FROM r1 GROUP BY 1
), m AS (SELECT key, arg_min(title, seq) FILTER (WHERE title <> '') AS title, arg_min(snippet, seq) FILTER (WHERE snippet <> '') AS snippet, count(DISTINCT (engine, variant)) AS support, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines,
  array_to_string(list_sort(list(DISTINCT variant)), ',') AS variants, array_to_string(list_sort(list(DISTINCT round)), ',') AS rounds FROM fo GROUP BY 1
), c AS (SELECT *, {rounded_sql("(coalesce(title <> '', false)::INT + coalesce(snippet <> '', false)::INT + (support > 9)::INT) / 3.0", 3)} AS completeness FROM m JOIN sc USING (key))
SELECT key, title, snippet, support, engines, variants, rounds, score, completeness FROM c ORDER BY score DESC, support DESC, completeness DESC, key LIMIT 50"""


def discovery_memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the earlier half of the events, met by the findings of the later half."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "'k' || (event_id % 700) AS key", "CASE WHEN event_id % 5 <> 0 THEN 't' || event_id END AS title", "CASE WHEN event_id % 3 = 0 THEN 's' || event_id ELSE '' END AS snippet", "CAST(NULL AS STRING) AS language", "(event_id % 7) / 6 AS completeness", "ts AS seen_at")
    old = e.filter("event_id < 600").selectExpr("key", "title", "snippet", "language", "completeness", "seen_at AS first_seen_at", "seen_at AS last_seen_at")
    return D.remember(old, e.filter("event_id >= 600")).drop("language")


REMEMBER_SQL = """WITH e AS (SELECT event_id, 'k' || (event_id % 700) AS key, CASE WHEN event_id % 5 <> 0 THEN 't' || event_id END AS title, CASE WHEN event_id % 3 = 0 THEN 's' || event_id ELSE '' END AS snippet, (event_id % 7) / 6 AS c, ts FROM events
), o AS (SELECT * FROM e WHERE event_id < 600), f AS (SELECT * FROM e WHERE event_id >= 600
), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, ts DESC) = 1), t AS (SELECT key, max(ts) AS latest, min(ts) AS since FROM f GROUP BY 1
), b AS (SELECT coalesce(o.key, n.key) AS key, o.title AS ot, o.snippet AS os, o.c AS oc, o.ts AS ots, n.title AS nt, n.snippet AS ns, n.c AS nc, latest, since, n.key IS NOT NULL AND (o.key IS NULL OR n.c >= o.c) AS better FROM o FULL JOIN n ON o.key = n.key LEFT JOIN t ON t.key = coalesce(o.key, n.key))
SELECT key, CASE WHEN better THEN coalesce(nullif(nt, ''), ot) ELSE ot END AS title, CASE WHEN better THEN coalesce(nullif(ns, ''), os) ELSE os END AS snippet, CASE WHEN better THEN nc ELSE oc END AS completeness,
  coalesce(ots, since) AS first_seen_at, greatest(coalesce(ots, latest), coalesce(latest, ots)) AS last_seen_at FROM b"""


def discovery_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent support of each record, from the observations of the first round and the new ones of the second."""
    f = _found(spark, sf_dir)
    keys = ["key", "engine", "variant"]
    known = f.filter("round = 1").select(*keys).distinct()
    both = known.unionByName(D.new_observations(known, f.filter("round = 2"), keys))
    rows = D.support(f.select("key").distinct(), both)
    return rows.select("key", F.array_join("engines", ",").alias("engines"), F.array_join("variants", ",").alias("variants"), "support")


SUPPORT_SQL = f"""WITH {_FOUND_SQL}, o AS (SELECT DISTINCT key, engine, variant FROM fo), k AS (SELECT DISTINCT key FROM fo)
SELECT k.key, coalesce(array_to_string(list_sort(list(DISTINCT engine) FILTER (WHERE engine IS NOT NULL)), ','), '') AS engines, coalesce(array_to_string(list_sort(list(DISTINCT variant) FILTER (WHERE variant IS NOT NULL)), ','), '') AS variants, count(engine) AS support FROM k LEFT JOIN o USING (key) GROUP BY 1"""

TELEMETRY = {"engine": "'e' || (event_id % 3)", "platform": SOURCE, "returned": "event_id % 20", "target": "event_id % 10", "accepted": "event_id % 5", "duplicates": "event_id % 2", "timeout": "event_id % 11 = 0", "rate_limited": "event_id % 13 = 0", "error": "event_id % 11 = 0 OR event_id % 13 = 0", "latency_ms": "value"}


def engine_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.engine_stats(table(spark, sf_dir, "events").selectExpr(*(f"{v} AS {k}" for k, v in TELEMETRY.items())), "engine", "platform")


def _rate(x: str, y: str) -> str:
    return rounded_sql(f"coalesce({x} / nullif({y}, 0), 0.0)", 4)


ENGINE_SQL = "WITH t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TELEMETRY.items()) + f""" FROM events), a AS (SELECT engine, platform, count(*) AS requests, {', '.join(f'sum({c}::BIGINT)::BIGINT AS {c}' for c in ('returned', 'target', 'accepted', 'duplicates', 'timeout', 'rate_limited', 'error'))}, sum(latency_ms) AS latency FROM t GROUP BY 1, 2)
SELECT engine, platform, requests, returned, target, accepted, duplicates, timeout, rate_limited, error, {_rate('target', 'returned')} AS precision, {_rate('accepted', 'requests')} AS yields, {_rate('duplicates', 'accepted')} AS duplicate_rate,
  {_rate('timeout', 'requests')} AS timeout_rate, {_rate('rate_limited', 'requests')} AS rate_limit_rate, {_rate('latency', 'requests')} AS mean_latency FROM a"""


def federated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages seen by instances: urls merged, first text kept, instances in order."""
    rows = table(spark, sf_dir, "events").selectExpr("'https://s.example.org/' || (event_id % 400) || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END AS url", "event_id AS seq", "'i' || (user_id % 5) AS instance", "'text ' || event_id AS text")
    return D.merged_instances(rows).select("key", "text", "seq", "n", F.array_join("instances", ",").alias("instances"))


FEDERATED_SQL = """WITH r AS (SELECT 'https://s.example.org/' || (event_id % 400) AS key, event_id AS seq, 'i' || (user_id % 5) AS instance FROM events), f AS (SELECT key, instance, min(seq) AS s FROM r GROUP BY 1, 2
), o AS (SELECT key, string_agg(instance, ',' ORDER BY s) AS instances FROM f GROUP BY 1)
SELECT key, 'text ' || min(seq) AS text, min(seq) AS seq, count(*) AS n, any_value(instances) AS instances FROM r JOIN o USING (key) GROUP BY 1"""


def discovery_variant_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(f"{SEARCH} AS search", "'q' || (event_id % 9) AS text", "event_id AS seq")
    return D.variants_within_budget(rows, "search", 4, 10)


BUDGET_SQL = f"""WITH o AS (SELECT {SEARCH} AS search, 'q' || (event_id % 9) AS text, min(event_id) AS seq FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY seq) AS n FROM o QUALIFY n <= 4)
SELECT search, text, n, 10 // count(*) OVER (PARTITION BY search) + (n <= 10 % count(*) OVER (PARTITION BY search))::INT AS engines FROM k"""

#: Queries of every kind, from a user and an event (fixed forms).
_ORIGINAL = "CASE event_id % 6 WHEN 0 THEN 'Open   Data ' || user_id WHEN 1 THEN 'محمد علي' WHEN 2 THEN '@User' || user_id WHEN 3 THEN '#Tag' || user_id WHEN 4 THEN 'CVE-2024-' || user_id ELSE 'Data بغداد ' || user_id END"
_FLAGS = {"exact": "event_id % 12 = 0", "person": "event_id % 6 = 1", "entity": "event_id % 6 = 0", "arabic": "event_id % 6 = 1", "mixed": "event_id % 6 = 5", "handle": "event_id % 6 = 2", "hashtag": "event_id % 6 = 3", "identifier": "event_id % 6 = 4"}
_ALIAS = {"text": "'alias ' || event_type", "confidence": "0.6D + value / 200"}
_MORE = {"n": "1", "text": "'More   of ' || event_type", "confidence": "CASE WHEN user_id % 3 = 0 THEN 0.5D ELSE 0.8D END", "drift": "value / 200"}


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = lambda columns: e.selectExpr("event_id AS query_id", *(f"{v} AS {k}" for k, v in columns.items()))
    return L.build(own({"original": _ORIGINAL} | _FLAGS), own(_ALIAS), own(_MORE))


def query_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of a query of some kind for every event."""
    return _lattice(spark, sf_dir).select("query_id", "position", "kind", "text", "confidence", "drift", "round")


_plain = lambda x: x.replace("D ", "::DOUBLE ").replace("5D", "5::DOUBLE").replace("6D", "6::DOUBLE").replace("8D", "8::DOUBLE")
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LATTICE_CTE = f"""q AS (SELECT event_id AS query_id, {_ORIGINAL} AS original, {', '.join(f'{v} AS {k}' for k, v in _FLAGS.items())}, event_type, value, user_id FROM events
), v AS (SELECT query_id, 0 AS place, 'ORIGINAL' AS kind, original AS text, 1.0::DOUBLE AS confidence, 0.0::DOUBLE AS drift, 1 AS round FROM q UNION ALL SELECT query_id, 1, 'NORMALIZED', lower(original), 0.98, 0.02, 1 FROM q
  UNION ALL SELECT query_id, 2, 'EXACT', '"' || original || '"', 0.97, 0.0, 1 FROM q WHERE exact OR person OR entity UNION ALL SELECT query_id, 3, 'ARABIC_NORMALIZED', original, 0.96, 0.03, 1 FROM q WHERE arabic OR mixed
  UNION ALL SELECT query_id, 4, 'HANDLE', original, 1.0, 0.0, 1 FROM q WHERE handle UNION ALL SELECT query_id, 5, 'HASHTAG', original, 1.0, 0.0, 1 FROM q WHERE hashtag UNION ALL SELECT query_id, 6, 'IDENTIFIER', original, 1.0, 0.0, 1 FROM q WHERE identifier
  UNION ALL SELECT query_id, 7, 'TRANSLITERATION', 'Mohammed Ali', 0.78, 0.18, 2 FROM q WHERE person AND arabic
  UNION ALL SELECT query_id, 101, 'ENTITY_ALIAS', 'alias ' || event_type, 0.6::DOUBLE + value / 200, greatest(0.05::DOUBLE, 1 - (0.6::DOUBLE + value / 200)), 2 FROM q WHERE NOT identifier AND 0.6::DOUBLE + value / 200 >= {L.LEAST_ALIAS}::DOUBLE
  UNION ALL SELECT query_id, 10001, 'EVIDENCE_EXPANDED', 'More of ' || event_type, 0.8, value / 200, 3 FROM q WHERE NOT identifier AND user_id % 3 <> 0 AND value / 200 <= {L.MOST_DRIFT}::DOUBLE
), la AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, kind, {_CLEAN.format('text')} AS text, confidence, drift, round FROM v QUALIFY position <= 6)"""
LATTICE_SQL = f"WITH {_LATTICE_CTE} SELECT query_id, position, kind, text, {rounded_sql('confidence', 6)} AS confidence, {rounded_sql('drift', 6)} AS drift, round FROM la"


def lattice_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second and the third round ask for every query."""
    return L.later(_lattice(spark, sf_dir)).filter("asked in (2, 3)").select("asked", "query_id", "kind", "text")


ROUNDS_SQL = f"""WITH {_LATTICE_CTE}, o AS (SELECT query_id, text AS root FROM la WHERE kind = 'ORIGINAL'), d AS (SELECT la.*, root FROM la JOIN o USING (query_id) WHERE {rounded_sql('drift', 6)} <= {L.MOST_DRIFT})
SELECT 2 AS asked, query_id, kind, text FROM d WHERE kind = 'EXACT' OR (kind IN ('ARABIC_NORMALIZED', 'TRANSLITERATION', 'ENTITY_ALIAS') AND lower(text) <> lower(root)) UNION ALL SELECT 3, query_id, kind, text FROM d WHERE kind = 'EVIDENCE_EXPANDED'"""

_SAID = ["history of {}", "breaking {}", "recent {}", "{} 1998", "CVE-2024-1234 {}", "{} today", "{}", "عاجل {}", "{} archive", "newest {}"]
_RANGES = ["all", "24h", "all", "7d", "all", "30d", "all"]


def temporal_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What queries about each event's type want of time."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("user_id") % len(_SAID) + 1).cast("int"))
    wanted = F.element_at(F.array(*map(F.lit, _RANGES)), (F.col("event_id") % len(_RANGES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(said, F.lit("{}"), F.col("event_type")).alias("q"), wanted.alias("time_range"))
    return rows.select("event_id", "q", L.temporal_intent(text.tokens(F.col("q")), F.col("q"), F.col("time_range"), F.col("q").startswith("CVE-")).alias("intent"))


_WORDS = "regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')"
_any = lambda words: f"len(list_intersect({_WORDS}, {words!r})) > 0"
TEMPORAL_SQL = f"""WITH e AS (SELECT event_id, replace(({_SAID!r})[user_id % {len(_SAID)} + 1], '{{}}', event_type) AS q, ({_RANGES!r})[event_id % {len(_RANGES)} + 1] AS r FROM events)
SELECT event_id, q, CASE WHEN r = '24h' THEN 'TIME_CRITICAL' WHEN r = '7d' THEN 'RECENT_PREFERRED' WHEN {_any(L.HISTORICAL)} OR (regexp_matches(q, '\\b(19|20)[0-9]{{2}}\\b') AND NOT starts_with(q, 'CVE-')) THEN 'HISTORICAL'
  WHEN {_any(L.CRITICAL)} THEN 'TIME_CRITICAL' WHEN {_any(L.RECENT)} OR r = '30d' THEN 'RECENT_PREFERRED' ELSE 'TIME_NEUTRAL' END AS intent FROM e"""


def lattice_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a variant of the benchmark's queries matches: enough of its distinct words."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("original"), *(F.lit(False).alias(c) for c in ("exact", "person", "entity", "arabic", "mixed", "handle", "hashtag", "identifier")))
    docs = documents(spark, sf_dir).select("item_id", F.col("text").alias("words"), F.lit("").alias("evidence"))
    return L.matches_any(docs, L.build(b))


MATCHES_SQL = """WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS ws FROM benchmark), e AS (SELECT query_id, len(ws) AS n, unnest(ws) AS word FROM q WHERE len(ws) > 0
), d AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'))) AS word FROM documents)
SELECT item_id, query_id FROM d JOIN e USING (word) GROUP BY item_id, query_id, n HAVING count(*) >= CASE WHEN n <= 2 THEN n ELSE ceil(n * 0.6) END"""


def evidence_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expansions of each language's query, from the documents of that language as its results."""
    d = documents(spark, sf_dir)
    queries = d.select(F.col("language").alias("query_id"), F.lit("the new").alias("original"), (F.col("language") == "es").alias("closed")).distinct()
    return L.expansions(queries, d.select(F.col("language").alias("query_id"), F.concat_ws(":", "source", F.col("item_id").cast("string")).alias("result_id"), "text"))


EXPANSIONS_SQL = f"""WITH r AS (SELECT DISTINCT lang AS query_id, doc_id, source, raw FROM (SELECT lang, doc_id, source, unnest(regexp_extract_all(text, '[#@]?[\\p{{L}}\\p{{N}}_.-]+')) AS raw FROM documents WHERE lang <> 'es')
), t AS (SELECT *, replace(lower(raw), 'ß', 'ss') AS term FROM r), k AS (SELECT * FROM t WHERE length(term) >= 4 AND term NOT IN ({', '.join(f"'{w}'" for w in L.COMMON)}) AND NOT regexp_matches(term, '^\\p{{N}}+$') AND term NOT IN ('the', 'new')
), a AS (SELECT query_id, term, count(DISTINCT doc_id) AS n_results, count(DISTINCT source) AS n_sources, min(raw) AS raw FROM k GROUP BY 1, 2
), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_results DESC, term)::INT AS n FROM a QUALIFY n <= 2
), c AS (SELECT *, {rounded_sql('least(0.92, 0.52 + 0.1 * n_results + 0.06 * n_sources)', 6)} AS confidence, CASE WHEN n_sources >= 3 THEN 0.22 ELSE 0.3 END AS drift FROM b)
SELECT query_id, n, term, 'the new ' || raw AS text, n_results, n_sources, confidence, drift,
  (regexp_matches(raw, '^[#@]') OR regexp_matches(raw, '[\\p{{N}}.\\-]') OR (length(raw) >= 6 AND regexp_matches(raw, '\\p{{Lu}}'))) AND n_results >= 3 AND n_sources >= 2 AND confidence >= 0.78 AS accepted FROM c"""

OBSERVED = {"left": "'n' || (user_id % 60)", "right": "'m' || (event_id % 7)", "relation": "CASE WHEN event_id % 2 = 0 THEN 'public_handle' ELSE 'same_as' END", "evidence_source": "'s' || (event_id % 3)", "direct": "event_id % 31 = 0", "seq": "event_id"}
_OBSERVED_SQL = "ob AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in OBSERVED.items()) + " FROM events)"
_ALIAS_SQL = f"""{_OBSERVED_SQL}, fr AS (SELECT *, (row_number() OVER (PARTITION BY "left", "right", relation, evidence_source ORDER BY seq) = 1)::INT AS fresh FROM ob
), nu AS (SELECT *, row_number() OVER (PARTITION BY "left", "right", relation ORDER BY seq) AS i FROM fr
), fold AS (SELECT "left", "right", relation, i, fresh AS support, CASE WHEN direct THEN 0.8 ELSE 0.55 END::DOUBLE AS c FROM nu WHERE i = 1
  UNION ALL SELECT nu."left", nu."right", nu.relation, nu.i, support + fresh, least(0.98, greatest(c, CASE WHEN direct THEN 0.8 ELSE 0.55 END) + 0.1 * fresh) FROM fold JOIN nu ON nu."left" = fold."left" AND nu."right" = fold."right" AND nu.relation = fold.relation AND nu.i = fold.i + 1
), ed AS (SELECT "left", "right", relation, arg_max(support, i)::BIGINT AS support, {rounded_sql('arg_max(c, i)', 6)} AS confidence FROM fold GROUP BY 1, 2, 3
), al AS (SELECT *, CASE WHEN support >= 2 AND confidence >= 0.8 THEN 'supported' ELSE 'observed' END AS status FROM ed)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.alias_edges(table(spark, sf_dir, "events").selectExpr(*(f"{v} AS {k}" for k, v in OBSERVED.items())))


def alias_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select(F.col("left").alias("left_name"), F.col("right").alias("right_name"), "relation", "support", "confidence", "status")


ALIAS_SQL = f'WITH RECURSIVE {_ALIAS_SQL} SELECT "left" AS left_name, "right" AS right_name, relation, support, confidence, status FROM al'


def admissible_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.range(70).select(F.col("id").alias("query_id"), F.when(F.col("id") < 60, F.concat(F.lit("N"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("m"), (F.col("id") - 60).cast("string"))).alias("original"))
    return L.admissible_aliases(_edges(spark, sf_dir), queries)


ADMISSIBLE_SQL = f"""WITH RECURSIVE {_ALIAS_SQL}, q AS (SELECT i AS query_id, CASE WHEN i < 60 THEN 'n' || i ELSE 'm' || (i - 60) END AS q FROM range(70) t(i)
), b AS (SELECT query_id, "right" AS alias, confidence, "right" FROM q JOIN al ON q = "left" WHERE status = 'supported' UNION ALL SELECT query_id, "left", confidence, "right" FROM q JOIN al ON q = "right" WHERE status = 'supported')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, "right", alias)::INT AS n, alias, confidence FROM b QUALIFY n <= 5"""

QUERIES = {
    "coverage_gaps": (coverage_gaps, _GAPS_SQL + " SELECT * EXCLUDE (failed) FROM g"),
    "coverage_status": (coverage_status, STATUS_SQL),
    "coverage_lanes": (coverage_lanes, LANES_SQL),
    "search_outcomes": (search_outcomes, OUTCOMES_SQL),
    "source_health": (source_health, HEALTH_SQL),
    "discovery_merged_top": (discovery_merged_top, MERGED_SQL),
    "discovery_memory_merge": (discovery_memory_merge, REMEMBER_SQL),
    "discovery_support": (discovery_support, SUPPORT_SQL),
    "engine_performance": (engine_performance, ENGINE_SQL),
    "federated_merge": (federated_merge, FEDERATED_SQL),
    "discovery_variant_budget": (discovery_variant_budget, BUDGET_SQL),
    "query_lattice": (query_lattice, LATTICE_SQL),
    "lattice_rounds": (lattice_rounds, ROUNDS_SQL),
    "lattice_matches": (lattice_matches, MATCHES_SQL),
    "temporal_intents": (temporal_intents, TEMPORAL_SQL),
    "evidence_expansions": (evidence_expansions, EXPANSIONS_SQL),
    "alias_observations": (alias_observations, ALIAS_SQL),
    "admissible_aliases": (admissible_aliases, ADMISSIBLE_SQL),
}
