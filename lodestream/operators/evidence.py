"""The evidence graph: nodes with properties, edges with support, folded from observations.

Every observation names nodes and edges it saw, with properties.  Folding is an
aggregate that combines before the shuffle: a property is a row of its own, and
its last writer wins, so a node that every observation names costs a row a
task and property.  The stored graph takes part as observations of its own, so
an upsert is the same fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a key or label that are kept, and tags of one observation (fixed values).
BOUND, TAGS = 500, 20


def bounded(x: Column) -> Column:
    return F.substring(F.trim(x), 1, BOUND)


def node(kind: str, key: Column, label: Column, properties: Column | None = None) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(kind).alias("kind"), bounded(key).alias("key"), bounded(label).alias("label"), (properties if properties is not None else none).alias("properties"))


def edge(left: Column, relation: str, right: Column, properties: Column | None = None) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.struct(left.kind.alias("from_kind"), left.key.alias("from_key"), F.lit(relation).alias("relation"), right.kind.alias("to_kind"), right.key.alias("to_key"), (properties if properties is not None else none).alias("properties"))


def merged_maps(rows: DataFrame, keys: list[str], seq: str = "seq", properties: str = "properties") -> DataFrame:
    """keys and properties: of each key's maps, every entry by its last writer (on equal seq, the greatest value)."""
    entries = rows.select(*keys, seq, F.explode(properties).alias("k", "v"))
    last = entries.groupBy(*keys, "k").agg(F.max(F.struct(F.col(seq).alias("s"), F.col("v").alias("v"))).alias("last"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("k"), F.col("last.v").alias("v"))))).alias(properties))


def fold_nodes(observed: DataFrame) -> DataFrame:
    """kind, key, label (the first), properties, first_seen, last_seen from rows (kind, key, label, properties, seq)."""
    keys = ["kind", "key"]
    seen = observed.groupBy(*keys).agg(F.min(F.struct("seq", "label")).alias("first"), F.max("seq").alias("last_seen"))
    both = seen.join(merged_maps(observed, keys), keys, "left")
    return both.select(*keys, F.col("first.label").alias("label"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), F.col("first.seq").alias("first_seen"), "last_seen")


def fold_edges(observed: DataFrame) -> DataFrame:
    """The edges' keys, support, properties, first_seen, last_seen from rows (keys, properties, seq, support)."""
    keys = ["from_kind", "from_key", "relation", "to_kind", "to_key"]
    seen = observed.groupBy(*keys).agg(F.sum("support").alias("support"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"))
    both = seen.join(merged_maps(observed, keys), keys, "left")
    return both.select(*keys, "support", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "first_seen", "last_seen")


def upsert_nodes(current: DataFrame, observed: DataFrame) -> DataFrame:
    """current (as `fold_nodes` gives it) with later observations folded in."""
    old = current.select("kind", "key", "label", "properties", F.col("last_seen").alias("seq"), F.col("first_seen").alias("since"))
    both = old.unionByName(observed.select("kind", "key", "label", "properties", "seq", F.col("seq").alias("since")))
    first = both.groupBy("kind", "key").agg(F.min(F.struct("since", "label")).alias("f"))
    return fold_nodes(both.drop("since")).join(first, ["kind", "key"]).select("kind", "key", F.col("f.label").alias("label"), "properties", F.col("f.since").alias("first_seen"), "last_seen")


def upsert_edges(current: DataFrame, observed: DataFrame) -> DataFrame:
    """current (as `fold_edges` gives it) with later observations folded in."""
    keys = ["from_kind", "from_key", "relation", "to_kind", "to_key"]
    old = current.select(*keys, "properties", F.col("last_seen").alias("seq"), "support", F.col("first_seen").alias("since"))
    both = old.unionByName(observed.select(*keys, "properties", "seq", "support", F.col("seq").alias("since")))
    first = both.groupBy(*keys).agg(F.min("since").alias("since"))
    return fold_edges(both.drop("since")).join(first, keys).select(*keys, "support", "properties", F.col("since").alias("first_seen"), "last_seen")


def observe(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that search results show.

    results: seq, query, content_id, url, source, and handle, hashtags (the
    first TAGS count), story, session (each may be null), properties of the
    content (map).  Keys of queries, handles and tags ignore case; a url's key
    is its SHA-256.
    """
    r, text = F.col, lambda c: F.col(c).cast("string")
    query = node("query", F.lower(r("query")), r("query"))
    content = node("content", text("content_id"), text("content_id"), r("properties"))
    url = node("canonical_url", F.sha2(r("url"), 256), r("url"))
    source = node("source", r("source"), r("source"))
    handle = node("author_handle", F.lower(r("handle")), r("handle"))
    story = node("story", r("story"), r("story"))
    tags = F.coalesce(F.slice("hashtags", 1, TAGS), F.array().cast("array<string>"))
    some = lambda test, made: F.when(test, F.array(made)).otherwise(F.slice(F.array(made), 1, 0))
    has_handle, has_story = F.coalesce(r("handle") != "", F.lit(False)), F.coalesce(r("story") != "", F.lit(False))
    nodes = F.concat(F.array(query, content, url, source), some(has_handle, handle), some(has_story, story), F.transform(tags, lambda t: node("hashtag", F.lower(t), t)))
    session = F.map_filter(F.create_map(F.lit("session_id"), text("session")), lambda k, v: v.isNotNull())
    edges = F.concat(
        F.array(edge(query, "discovered_by", content, session), edge(content, "links_to", url), edge(content, "published_on", source)), some(has_handle, edge(content, "mentions_author", handle)),
        some(has_story, edge(content, "same_story", story, F.create_map(F.lit("algorithmic"), F.lit("true")))), F.transform(tags, lambda t: edge(content, "mentions", node("hashtag", F.lower(t), t))),
    )
    return results.select("seq", F.explode(nodes).alias("x")).select("x.*", "seq"), results.select("seq", F.explode(edges).alias("x")).select("x.*", "seq", F.lit(1).cast("long").alias("support"))
