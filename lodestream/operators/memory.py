"""Local memory: what is already stored, looked up by lanes.

The literal lane finds items by id or handle, a lane for each variant of the
query takes the best of the full-text index, and the remembered discoveries
follow, newest first, as far as they match a variant and show a new url.
Every lane is a bounded top k, so the union is small however large the memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import rounded
from lodestream.operators import retrieval as R
from lodestream.sources.scratch import materialise

MOST = 200


def literal_lane(content: DataFrame, query: str, limit: int = MOST) -> DataFrame:
    """item_id, place of the items whose external_id or handle is the query, newest id first.

    Only a query that starts with @ or #, or has a hyphen, is literal.
    """
    literal = query.strip().strip('"')
    rows = content.select("item_id", "external_id", "handle")
    if not literal or not (literal[0] in "@#" or "-" in literal):
        rows = rows.filter(F.lit(False))
    plain = literal.removeprefix("@").removeprefix("#").lower()
    found = rows.filter((F.lower("external_id") == plain) | (F.lower("handle") == literal.lower())).orderBy(F.col("item_id").desc()).limit(limit)
    return found.select("item_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("item_id").desc())).alias("place"))


def index_lane(indexed: DataFrame, query: R.Query, limit: int = MOST) -> DataFrame:
    """item_id, place of the best items of the full-text index."""
    if not query.words:
        return indexed.select("item_id", F.lit(0).alias("place")).limit(0)
    # equal items score alike, in whatever order their words were summed
    best = R.bm25_of(indexed, query).withColumn("bm25", rounded(F.col("bm25"), 9)).orderBy(F.col("bm25").desc(), "item_id").limit(limit)
    return best.select("item_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("bm25").desc(), "item_id")).alias("place"))


def ordered_union(lanes: list[DataFrame], key: str, limit: int) -> DataFrame:
    """key, lane, position: each key once, where it first appears, lanes in order; the first `limit`."""
    both = None
    for lane, rows in enumerate(lanes):
        one = rows.select(key, F.lit(lane).alias("lane"), "place")
        both = one if both is None else both.unionByName(one)
    first = both.groupBy(key).agg(F.min(F.struct("lane", "place")).alias("at")).select(key, "at.lane", "at.place").orderBy("lane", "place").limit(limit)
    return first.select(key, "lane", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lane", "place")).alias("position"))


def search(content: DataFrame, records: DataFrame, query: str, variants: list[R.Query], now: Column, limit: int = MOST, historical: bool = False) -> DataFrame:
    """position, kind, key, canonical_url, historical of what local memory has for a query.

    content: item_id, external_id, handle, title, text, canonical_url,
    published_at, first_seen_at; records: record_id, title, snippet,
    canonical_url, last_seen_at.  Stored items come first, by lane; of the
    newest min(1000, 10 x limit) records those that match a variant follow,
    one a url, while there is room.  In historical mode items older than 30
    days and all records are marked.
    """
    limit = max(1, min(limit, MOST))
    words = sorted({w for v in variants for w in v.distinct})
    indexed = materialise(R.index(content, words), "index")
    ids = ordered_union([literal_lane(content, query, limit), *(index_lane(indexed, v, limit) for v in variants)], "item_id", limit)
    ids = materialise(ids, "lanes")
    # at most `limit` ids: their rows come by one broadcast join
    seen = F.coalesce("published_at", "first_seen_at")
    stored = content.select("item_id", "canonical_url", "published_at", "first_seen_at").join(F.broadcast(ids), "item_id")
    stored = materialise(stored.select("position", F.lit("content").alias("kind"), F.col("item_id").alias("key"), "canonical_url", (F.lit(historical) & (seen < now - F.expr("INTERVAL 30 DAYS"))).alias("historical")), "stored")
    newest = records.orderBy(F.col("last_seen_at").desc(), "record_id").limit(min(1000, 10 * limit))
    keep = ["canonical_url", "last_seen_at"]
    found = materialise(R.index(newest.select(F.col("record_id").alias("item_id"), "title", F.coalesce("snippet", F.lit("")).alias("text"), *keep), words, [*keep, "handle", "hashtags"]), "records")
    match = F.lit(False)
    for v in variants:
        match = match | R.matches(v)
    found = found.filter(match).join(F.broadcast(stored.select("canonical_url")), "canonical_url", "left_anti")
    once = Window.partitionBy("canonical_url").orderBy(F.col("last_seen_at").desc(), "item_id")
    found = found.withColumn("n", F.row_number().over(once)).filter("n = 1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("last_seen_at").desc(), "item_id")  # of at most 1,000 rows
    offset = stored.agg(F.count(F.lit(1)).alias("before"))
    found = found.withColumn("r", F.row_number().over(order)).join(F.broadcast(offset)).withColumn("position", (F.col("before") + F.col("r")).cast("int"))
    found = found.select("position", F.lit("discovery").alias("kind"), F.col("item_id").alias("key"), "canonical_url", F.lit(historical).alias("historical"))
    return stored.unionByName(found).filter(F.col("position") <= limit)
