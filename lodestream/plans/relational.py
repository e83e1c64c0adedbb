"""Joins, set operations, planning, learning, writes and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import rounded
from lodestream.operators import intervals as I
from lodestream.operators import planning as P
from lodestream.operators import snapshots as N
from lodestream.operators import writes as X
from lodestream.sources.tables import NOW_SQL, now, rounded_sql, table
from lodestream.streaming import breaker as B
from lodestream.streaming import registry as G
from lodestream.streaming import streams as S


def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner and left joins along a star: the dimensions are small, Spark broadcasts those under its bound."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("revenue"))


STAR_SQL = f"""SELECT n_name, o_orderpriority, count(*) AS n, {rounded_sql('sum(l_extendedprice)', 2)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""


def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    semi = orders.join(items, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
    anti = orders.join(items, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
    return semi.select(F.lit("semi").alias("kind"), "n", "s").unionByName(anti.select(F.lit("anti").alias("kind"), "n", "s"))


SEMI_SQL = """SELECT 'semi' AS kind, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'anti', count(*), sum(o_custkey)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"""


def join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key equi-join: each user's events of one type on one day against the next type's."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    per = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    joined = e.join(per, ["user_id", "day"]).filter(F.col("value") == F.col("top"))
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_tops"), F.sum("n").alias("n_events"))


COMPOSITE_SQL = """WITH e AS (SELECT user_id, ts::DATE AS day, event_type, value FROM events), p AS (SELECT user_id, day, count(*) AS n, max(value) AS top FROM e GROUP BY 1, 2)
SELECT event_type, count(*) AS n_tops, sum(n)::BIGINT AS n_events FROM e JOIN p USING (user_id, day) WHERE value = top GROUP BY 1"""


def join_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's n-th event of each type with the user's n-th of the next type: equal occurrence numbers."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    numbered = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    kinds = e.select("event_type").distinct()
    following = kinds.alias("k").join(kinds.select(F.col("event_type").alias("next_type")), F.col("next_type") > F.col("event_type")).groupBy("event_type").agg(F.min("next_type").alias("next_type"))  # of a handful of types
    right = numbered.select("user_id", "n", F.col("event_type").alias("next_type"), F.col("event_id").alias("right_id"))
    return numbered.join(following, "event_type").join(right, ["user_id", "next_type", "n"]).select("event_type", "next_type", "user_id", "n", F.col("event_id").alias("left_id"), "right_id")


OCCURRENCE_SQL = """WITH k AS (SELECT event_type, lead(event_type) OVER (ORDER BY event_type) AS next_type FROM (SELECT DISTINCT event_type FROM events)), r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT a.event_type, next_type, a.user_id, a.n, a.event_id AS left_id, b.event_id AS right_id FROM r a JOIN k USING (event_type) JOIN r b ON a.user_id = b.user_id AND a.n = b.n AND b.event_type = next_type"""


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union_all": c.unionAll(s), "union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.exceptAll(s), "subtract": c.subtract(s)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("s")).select(F.lit(name).alias("op"), "n", "s")
        out = one if out is None else out.unionByName(one)
    return out


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
SETS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS s FROM ({_C} {op} {_S})" for n, op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT ALL"), ("subtract", "EXCEPT"))
)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as search resources, their observed rates from the documents themselves."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    a = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("m").alias("u"), F.avg("n_chars").alias("c"), F.sum((F.col("lang") == "en").cast("int")).alias("en"))
    return a.select("source", (100.0 * F.col("en") / F.col("n")).alias("capability"), F.lit(75.0).alias("intent"), F.lit(82.0).alias("language"), F.lit(75.0).alias("temporal"), (F.col("u") / F.col("n")).alias("yields"),
                    (F.col("u") / F.col("n")).alias("unique"), (1 - F.col("u") / F.col("n")).alias("duplicates"), F.col("c").alias("latency_ms"), F.when(F.col("n") % 7 == 0, 55.0).otherwise(100.0).alias("availability"))


def resource_utility_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.utility(_sources(spark, sf_dir)).withColumn("query_id", F.lit(0))
    _, max_rounds, calls = P.BUDGETS["balanced"]
    return P.rounds(rows, "query_id", calls, max_rounds).select("source", "long_term", "total", "position", "round")


UTILITY_SQL = f"""WITH a AS (SELECT source, count(*) AS n, count(DISTINCT text) AS u, avg(n_chars) AS c, count(*) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY 1
), b AS (SELECT source, n, u / n AS y, greatest(20.0, 100.0 - least(c, 8000.0) / 100.0) AS lat, 100.0 * en / n AS cap FROM a
), l AS (SELECT source, n, {rounded_sql('0.27 * cap + 0.23 * 75 + 0.10 * 82 + 0.10 * 75 + 0.10 * 100 * y + 0.08 * 100 * y + 0.05 * lat + 0.04 * 100 * (1 - (1 - y)) + 0.03 * (100 * y + 100 * (1 - (1 - y))) / 2', 4)} AS long_term FROM b
), t AS (SELECT *, {rounded_sql('long_term * (0.25 + 0.75 * CASE WHEN n % 7 = 0 THEN 55.0 ELSE 100.0 END / 100.0)', 4)} AS total FROM l
), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, source) AS position FROM t QUALIFY position <= 12)
SELECT source, long_term, total, position, ceil(position / ceil(count(*) OVER () / 2))::BIGINT AS round FROM r"""


def uncertainty_gain_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one search's candidates: risk, level, gain and stop reason."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"), (F.col("event_id") % 10 / 10).alias("completeness"), "event_type", (F.col("event_id") % 3).alias("variant"), F.col("value").alias("lexical"), F.lit(50.0).alias("semantic"))
    u = P.uncertainty(rows.withColumnRenamed("event_type", "engine"), "user_id", "event_id")
    gained = P.gain(F.col("n"), F.col("sources"), F.col("engines"), F.lit(0), F.lit(0), F.col("n"), F.lit(1000.0))
    u = u.withColumn("gain", rounded(gained, 6))
    return u.select("user_id", "n", "risk", "level", "gain", P.stop_reason(F.col("level"), F.col("gain"), F.col("n"), 60, F.lit(2), 3, F.col("sources") - 3).alias("stop"))


STOP_SQL = f"""WITH a AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id % 4) AS sources, avg(event_id % 10 / 10) AS completeness, count(DISTINCT event_type) AS engines, count(DISTINCT event_id % 3) AS variants, coalesce(avg(abs(value - 50.0)), 0) AS dis FROM events GROUP BY 1
), p AS (SELECT *, CASE WHEN n < 5 THEN 2 WHEN n < 10 THEN 1 ELSE 0 END + (sources = 1)::INT + CASE WHEN completeness < 0.35 THEN 2 WHEN completeness < 0.6 THEN 1 ELSE 0 END + (engines = 1)::INT + CASE WHEN dis > 35 THEN 2 ELSE 0 END AS p0 FROM a
), q AS (SELECT *, CASE WHEN variants > 1 THEN greatest(0, p0 - 1) ELSE p0 END AS p1 FROM p
), r AS (SELECT *, CASE WHEN sources >= 3 AND n >= 10 AND completeness >= 0.55 THEN greatest(0, p1 - 2) ELSE p1 END AS risk FROM q
), l AS (SELECT *, CASE WHEN risk <= 1 THEN 'LOW' WHEN risk <= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS level, {rounded_sql('ln(1 + n + 1.5 * sources + 2.0 * engines) / greatest(1.0, n + 0.2)', 6)} AS gain FROM r)
SELECT user_id, n, risk, level, gain, CASE WHEN n >= 60 THEN 'USER_LIMIT' WHEN level = 'LOW' AND n >= 10 THEN 'SATISFIED' WHEN gain < 0.12 THEN 'LOW_MARGINAL_GAIN' WHEN sources - 3 > 0 THEN NULL ELSE 'SOURCE_EXHAUSTION' END AS stop FROM l"""


def source_utility_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_type", (F.col("user_id") % 10).alias("source"), F.col("ts").alias("at"), (F.col("event_id") % 20).alias("returned"), (F.col("event_id") % 7).alias("admitted"), (F.col("event_id") % 11).alias("unique_count"), (F.col("event_id") % 5).alias("top_k"),
                    (F.col("event_id") % 10 / 10).alias("duplicate_rate"), (F.col("value") * 100).alias("latency_ms"), (F.col("event_type") == "error").alias("failed"))
    return P.learned_adjustment(rows, ["event_type", "source"], now())


DECAY_SQL = f"""WITH o AS (SELECT event_type, user_id % 10 AS source, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(ts)) / 8.64e10) / 30.0) AS w, event_id % 20 AS ret, event_id % 7 AS adm, event_id % 11 AS uni, event_id % 5 AS top, event_id % 10 / 10 AS dup, value * 100 AS lat FROM events
), s AS (SELECT event_type, source, w, 0.35 * least(1.0, adm / greatest(1, ret)) + 0.30 * least(1.0, uni / greatest(1, ret)) + 0.20 * least(1.0, top / greatest(1, adm)) - 0.10 * least(1.0, dup) - 0.03 * least(1.0, lat / 8000) - 0.02 * (event_type = 'error')::INT AS score FROM o
), g AS (SELECT event_type, source, count(*) AS n, sum(w * score) AS s, sum(w) AS w FROM s GROUP BY 1, 2)
SELECT event_type, source, n, CASE WHEN n < 5 THEN 0.0 ELSE {rounded_sql('greatest(-8.0, least(8.0, (s / greatest(w, 1e-9) - 0.35) * 10))', 3)} END AS adjustment FROM g"""


def evidence_graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges source-language and source-length band: yesterday's table and today's observations, support added up."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    edge = lambda r: r.select(F.explode(F.array(F.struct(F.col("source").alias("left_key"), F.col("lang").alias("right_key")), F.struct(F.col("source").alias("left_key"), F.concat(F.lit("len"), F.floor(F.log10(F.greatest(F.lit(1), F.col("n_chars")))).cast("string")).alias("right_key")))).alias("e")).select("e.*")
    keys = ["left_key", "right_key"]
    current = edge(d.filter("doc_id % 2 = 0")).groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    return X.merge_edges(current, edge(d.filter("doc_id % 2 = 1")), keys)


GRAPH_SQL = """WITH e AS (SELECT source AS left_key, lang AS right_key FROM documents UNION ALL SELECT source, 'len' || floor(log10(greatest(1, n_chars)))::INT FROM documents)
SELECT left_key, right_key, count(*)::BIGINT AS support FROM e GROUP BY 1, 2"""


def content_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored half of the customers met by a newer delivery that overlaps it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    current = c.filter("c_custkey % 3 <> 0").withColumn("seen", F.lit(1))
    incoming = c.filter("c_custkey % 2 = 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seen"))
    extra = {"seen": F.coalesce(F.col("cur.seen"), F.lit(0)) + F.coalesce(F.col("new.seen"), F.lit(0))}
    return X.upsert(current, incoming, ["c_custkey"], ["c_nationkey"], ["c_acctbal"], extra)


UPSERT_SQL = """WITH cur AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_nationkey + 100 AS c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(cur.c_custkey, new.c_custkey) AS c_custkey, coalesce(cur.c_nationkey, new.c_nationkey) AS c_nationkey, coalesce(new.c_acctbal, cur.c_acctbal) AS c_acctbal, (cur.c_custkey IS NOT NULL)::INT + (new.c_custkey IS NOT NULL)::INT AS seen
FROM cur FULL JOIN new ON cur.c_custkey = new.c_custkey"""


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a day's life, stale ones marked, the newest fifty of each type kept."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    kept = X.evict(X.cache_state(e, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")), F.col("created_at").desc(), 50, "event_type")
    return kept.groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest"))


EVICT_SQL = """WITH k AS (SELECT *, CASE WHEN ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00' THEN 'cached' ELSE 'stale' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 50)
SELECT event_type, state, count(*) AS n, min(event_id) AS oldest FROM k GROUP BY 1, 2"""


def breaker_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.breaker_intervals(e, "user_id", ["ts", "event_id"], F.col("value") < 20, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


BREAKER_SQL = """WITH r AS (SELECT user_id, (value < 20)::INT AS failed, epoch_us(ts) / 1e6 AS sec, sum(1 - (value < 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, count(*) AS failures, min(sec) AS first, max(sec) AS last, max(sec) + 60.0 AS open_until FROM r WHERE failed = 1 GROUP BY user_id, island HAVING count(*) >= 2"""


_REASONS = ["Captcha required", "HTTP error 429", "Read timeout", "Connection refused"]


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of five engines, one in three a failure; a second of the rules is a minute here, as events are minutes apart."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    reason = F.when(F.col("value") < 30, F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % 4 + 1).cast("int")))
    return B.walk(e, "event_type", ["event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 6e7, B.cause(reason))


def breaker_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its breaker after it."""
    return _walked(spark, sf_dir).select("event_type", "event_id", "failed", "skipped", "failures", "open_until", B.state_name(F.col("failed")).alias("state"))


def breaker_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time a breaker opened: when, until when, why, and what it skipped."""
    return B.openings(_walked(spark, sf_dir), "event_type")


_WALK_CTE = f"""r AS (SELECT event_type, event_id, epoch_us(ts) / 6e7 AS at, CASE WHEN value < 30 THEN (['captcha', 'rate', 'timeout', 'other'])[event_id % 4 + 1] END AS failed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
), c(failed, cooldown, state) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE, '{B.STATE[k]}')" for k, v in B.COOLDOWN.items())}
), q AS (SELECT r.*, cooldown, coalesce(state, 'HEALTHY') AS state FROM r LEFT JOIN c USING (failed)
), w AS (SELECT q.*, false AS skipped, (failed IS NOT NULL)::INT AS failures, 0.0::DOUBLE AS open_until FROM q WHERE n = 1
  UNION ALL SELECT q.*, w.open_until > q.at, CASE WHEN w.open_until > q.at THEN w.failures WHEN q.failed IS NULL THEN 0 ELSE least(2, w.failures + 1) END,
    CASE WHEN w.open_until > q.at THEN w.open_until WHEN q.failed IS NULL OR w.failures = 0 THEN 0.0 ELSE q.at + q.cooldown END
  FROM w JOIN q ON q.event_type = w.event_type AND q.n = w.n + 1)"""
WALK_SQL = f"WITH RECURSIVE {_WALK_CTE} SELECT event_type, event_id, failed, skipped, failures, open_until, state FROM w"
OPENINGS_SQL = f"""WITH RECURSIVE {_WALK_CTE}, o AS (SELECT *, (NOT skipped AND failed IS NOT NULL AND open_until > w."at") AS opens FROM w)
SELECT event_type, open_until, min(o."at") FILTER (WHERE opens) AS opened, arg_min(failed, o."at") FILTER (WHERE opens) AS cause, count(*) FILTER (WHERE skipped) AS n_skipped FROM o WHERE opens OR skipped GROUP BY 1, 2"""


#: What an event of each type does to its user's configuration slots.
_OPS = {"purchase": "VERIFIED_PRODUCTION", "view": "PREVIOUS_PRODUCTION", "signup": "EXPERIMENTAL", "click": "PROMOTION_CANDIDATE", "error": "ROLLBACK"}


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in _OPS.items() for x in pair))
    return N.slots(table(spark, sf_dir, "events").select("user_id", "event_id", kinds[F.col("event_type")].alias("op")), "user_id", "event_id", "op")


def configuration_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of every user after each entry of the log."""
    return _slots(spark, sf_dir)


def configuration_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots in force at one version."""
    return N.as_of(_slots(spark, sf_dir), "user_id", "event_id", 3000)


_SLOTS_CTE = f"""o AS (SELECT user_id, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items())} END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), w AS (SELECT user_id, 0::BIGINT AS event_id, ''::VARCHAR AS op, 0::BIGINT AS n, true AS applied, NULL::BIGINT AS production, NULL::BIGINT AS previous, NULL::BIGINT AS experimental, NULL::BIGINT AS candidate FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT o.user_id, o.event_id, o.op, o.n, NOT (o.op = 'ROLLBACK' AND (w.production IS NULL OR w.previous IS NULL)),
    CASE o.op WHEN 'VERIFIED_PRODUCTION' THEN o.event_id WHEN 'ROLLBACK' THEN CASE WHEN w.production IS NULL OR w.previous IS NULL THEN w.production ELSE w.previous END ELSE w.production END,
    CASE o.op WHEN 'PREVIOUS_PRODUCTION' THEN o.event_id WHEN 'ROLLBACK' THEN CASE WHEN w.production IS NULL OR w.previous IS NULL THEN w.previous ELSE w.production END ELSE w.previous END,
    CASE o.op WHEN 'EXPERIMENTAL' THEN o.event_id ELSE w.experimental END, CASE o.op WHEN 'PROMOTION_CANDIDATE' THEN o.event_id ELSE w.candidate END
  FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)"""
SLOTS_SQL = f"WITH RECURSIVE {_SLOTS_CTE} SELECT user_id, event_id, op, applied, production, previous, experimental, candidate FROM w WHERE n > 0"
AS_OF_SQL = f"WITH RECURSIVE {_SLOTS_CTE} SELECT user_id, production, previous, experimental, candidate FROM w WHERE n > 0 AND event_id <= 3000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


#: What events do to jobs, and the registry's bounds in minutes and jobs.
_JOB_EVENT, _TTL, _CAPACITY = "CASE WHEN value < 25 THEN 'start' WHEN value < 60 THEN 'completed' ELSE 'collect' END", 1500.0, 20


def job_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' jobs in one bounded registry a type of event: everything that is admitted, refused, evicted, ended or forgotten."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("registry"), F.concat(F.lit("j"), (F.col("user_id") % 60).cast("string")).alias("job"), F.expr(_JOB_EVENT).alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 6e7).alias("at"), F.col("event_id").alias("seq"))
    return G.changes(e, ttl=_TTL, capacity=_CAPACITY)


REGISTRY_SQL = f"""WITH RECURSIVE q AS (SELECT event_type AS registry, 'j' || (user_id % 60) AS job, {_JOB_EVENT} AS event, epoch_us(ts) / 6e7 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
), w AS (SELECT DISTINCT registry, 0::BIGINT AS n, []::STRUCT(j VARCHAR, a DOUBLE, e DOUBLE)[] AS jobs, []::STRUCT(j VARCHAR, c VARCHAR, t DOUBLE)[] AS made FROM q
  UNION ALL SELECT registry, n, CASE WHEN opens AND NOT crowded THEN list_append(CASE WHEN full_ THEN list_filter(alive, lambda x: x.j <> old.j) ELSE alive END, {{'j': job, 'a': t, 'e': NULL::DOUBLE}}) WHEN ends THEN list_transform(alive, lambda x: {{'j': x.j, 'a': x.a, 'e': CASE WHEN x.j = job THEN t ELSE x.e END}}) ELSE alive END,
    list_concat(list_transform(gone, lambda x: {{'j': x.j, 'c': 'expired', 't': greatest(x.e, x.a + {_TTL})}}), CASE WHEN opens AND crowded THEN [{{'j': job, 'c': 'refused', 't': t}}] WHEN opens AND full_ THEN [{{'j': old.j, 'c': 'evicted', 't': t}}, {{'j': job, 'c': 'admitted', 't': t}}] WHEN opens THEN [{{'j': job, 'c': 'admitted', 't': t}}] WHEN ends THEN [{{'j': job, 'c': 'ended', 't': t}}] ELSE [] END)
  FROM (SELECT *, full_ AND old IS NULL AS crowded FROM (SELECT *, event = 'start' AND len(list_filter(alive, lambda x: x.j = job)) = 0 AS opens, event = 'completed' AND len(list_filter(alive, lambda x: x.j = job AND x.e IS NULL)) > 0 AS ends, len(alive) >= {_CAPACITY} AS full_,
      list_sort(list_transform(list_filter(alive, lambda x: x.e IS NOT NULL), lambda x: {{'a': x.a, 'j': x.j}}))[1] AS old
    FROM (SELECT q.registry, q.n, q.job, q.event, q.t, list_filter(w.jobs, lambda x: x.e IS NULL OR greatest(x.e, x.a + {_TTL}) > q.t) AS alive, list_filter(w.jobs, lambda x: x.e IS NOT NULL AND greatest(x.e, x.a + {_TTL}) <= q.t) AS gone FROM w JOIN q ON q.registry = w.registry AND q.n = w.n + 1)))
) SELECT registry, m.j AS job, m.c AS change, m.t AS at FROM (SELECT registry, unnest(made) AS m FROM w)"""


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that each event starts, as many minutes long as its value, by type: its length, its union, what runs at once, and what of it falls into days 5 to 20."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.floor(F.col("value") * 60_000_000).alias("us"))
    day = 86_400_000_000
    windows = e.groupBy("event_type").agg(F.min("start").alias("first")).select("event_type", (F.col("first") + 5 * day).alias("low"), (F.col("first") + 20 * day).alias("high"))
    return I.overlap_accounts(e.select("event_type", "start", (F.col("start") + F.col("us")).alias("end")), windows, "event_type")


OVERLAP_SQL = """WITH v AS (SELECT event_type, epoch_us(ts) AS a, epoch_us(ts) + floor(value * 60000000)::BIGINT AS z FROM events), w AS (SELECT event_type, min(a) + 432000000000 AS low, min(a) + 1728000000000 AS high FROM v GROUP BY 1
), e AS (SELECT event_type, a AS t, 1 AS d FROM v WHERE a < z UNION ALL SELECT event_type, z, -1 FROM v WHERE a < z
), s AS (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS depth, lead(t) OVER (PARTITION BY event_type ORDER BY t, d) AS later FROM e
), l AS (SELECT event_type, sum(later - t) FILTER (WHERE depth > 0) AS "union", sum(later - t) FILTER (WHERE depth > 1) AS shared, max(depth)::BIGINT AS deepest FROM s GROUP BY 1
), o AS (SELECT event_type, count(*) AS n, sum(z - a) AS total, sum(greatest(0, least(z, high) - greatest(a, low))) AS overlap FROM v JOIN w USING (event_type) WHERE a < z GROUP BY 1)
SELECT event_type, n, total::BIGINT AS total, "union"::BIGINT AS "union", shared::BIGINT AS shared, deepest, overlap::BIGINT AS overlap, least(total, overlap)::BIGINT AS hidden FROM o JOIN l USING (event_type)"""


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    event = F.when((F.col("turn") >= 4) & (F.col("role") == "assistant"), "completed").otherwise(F.col("role"))
    return t.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("sequence"), event.alias("event"), F.length("text").cast("double").alias("amount"))


def event_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_state_batch(_job_events(spark, sf_dir))


FOLD_SQL = """WITH e AS (SELECT conv_id AS job_id, turn AS sequence, CASE WHEN turn >= 4 AND role = 'assistant' THEN 'completed' ELSE role END AS event, length(text)::DOUBLE AS amount FROM conversations
), k AS (SELECT *, coalesce(max((event IN ('completed', 'failed', 'cancelled'))::INT) OVER (PARTITION BY job_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT job_id, count(*) AS n_events, arg_max(event, sequence) AS phase, max(sequence) AS last_sequence, sum(amount) AS total, bool_or(event IN ('completed', 'failed', 'cancelled')) AS ended FROM k WHERE done = 0 GROUP BY 1"""


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(_job_events(spark, sf_dir), most=3).select("job_id", "sequence", "event", "age")


HISTORY_SQL = """SELECT conv_id AS job_id, turn AS sequence, CASE WHEN turn >= 4 AND role = 'assistant' THEN 'completed' ELSE role END AS event, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 3"""


def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the watermarked stream in lodestream.streaming (tests run both)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.tumbling(e, "ts", "6 hours", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


TUMBLING_SQL = f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {rounded_sql('sum(value)', 4)} AS total FROM events GROUP BY 1, 2"""


QUERIES = {
    "join_star": (join_star, STAR_SQL),
    "join_semi_anti": (join_semi_anti, SEMI_SQL),
    "join_composite": (join_composite, COMPOSITE_SQL),
    "join_occurrence": (join_occurrence, OCCURRENCE_SQL),
    "set_ops": (set_ops, SETS_SQL),
    "resource_utility_rounds": (resource_utility_rounds, UTILITY_SQL),
    "uncertainty_gain_stop": (uncertainty_gain_stop, STOP_SQL),
    "source_utility_decay": (source_utility_decay, DECAY_SQL),
    "evidence_graph_upsert": (evidence_graph_upsert, GRAPH_SQL),
    "content_upsert_merge": (content_upsert_merge, UPSERT_SQL),
    "cache_eviction": (cache_eviction, EVICT_SQL),
    "breaker_intervals": (breaker_intervals, BREAKER_SQL),
    "breaker_walk": (breaker_walk, WALK_SQL),
    "breaker_openings": (breaker_openings, OPENINGS_SQL),
    "configuration_log": (configuration_log, SLOTS_SQL),
    "configuration_as_of": (configuration_as_of, AS_OF_SQL),
    "job_registry": (job_registry, REGISTRY_SQL),
    "interval_overlap": (interval_overlap, OVERLAP_SQL),
    "event_fold_state": (event_fold_state, FOLD_SQL),
    "event_history": (event_history, HISTORY_SQL),
    "stream_tumbling_counts": (stream_tumbling_counts, TUMBLING_SQL),
}
