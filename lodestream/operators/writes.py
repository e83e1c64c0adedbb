"""Keyed merges and caches over immutable tables: a write returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str], refresh: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Full outer merge on keys: `keep` columns stay once set, `refresh` columns take the newer value if it has one.

    extra: further columns from the struct columns cur and new.
    """
    cur = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("cur"))
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("new"))
    both = cur.join(new, keys, "full_outer")
    columns = [F.coalesce(F.col(f"cur.{c}"), F.col(f"new.{c}")).alias(c) for c in keep] + [F.coalesce(F.col(f"new.{c}"), F.col(f"cur.{c}")).alias(c) for c in refresh]
    return both.select(*keys, *columns, *(e.alias(k) for k, e in (extra or {}).items()))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and the incoming rows whose key it lacks, the first of each."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in incoming.columns if c not in keys] or keys)
    fresh = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(current.columns))


def delete_cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children whose parent still exists."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    """children with `column` emptied where the parent it names is gone."""
    alive = parents.select(F.col(key).alias(column)).distinct().withColumn("_alive", F.lit(True))
    return children.join(alive, column, "left").withColumn(column, F.when(F.col("_alive"), F.col(column))).drop("_alive")


def orphans(children: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    return children.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def merge_edges(current: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Edge table with support counts added up."""
    return current.unionByName(observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))).groupBy(*keys).agg(F.sum("support").alias("support"))


def cache_state(entries: DataFrame, now: Column) -> DataFrame:
    return entries.withColumn("state", F.when(F.col("expires_at") > now, "cached").otherwise("stale"))


def evict(entries: DataFrame, newest: Column, most: int, by: str | None = None) -> DataFrame:
    """The newest `most` entries (of each `by`): a retention rule, its bound is the feature."""
    if by is None:
        return entries.orderBy(newest).limit(most)
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(newest))).filter(F.col("_n") <= most).drop("_n")


def activate(snapshots: DataFrame, slot: str, at: str) -> DataFrame:
    """The latest snapshot of each slot is active."""
    w = Window.partitionBy(slot).orderBy(F.col(at).desc())
    return snapshots.withColumn("active", F.row_number().over(w) == 1)
