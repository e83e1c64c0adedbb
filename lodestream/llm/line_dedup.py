"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites per line hash merges by aggregation, map side
first, so a line in a third of all rows is a few sketches by the time it is
shuffled.  Lines whose estimate is near the threshold get an exact distinct
count.  Lines on enough sites are boilerplate and are removed everywhere.
Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import materialise

MIN_SITES = 10
LG_K = 12  # of the sketches: 1.6 % standard error when full, all but exact for few sites
NEAR = 0.07  # four standard errors
BROADCAST_ROWS = 500_000  # of 16 bytes


def _hashes(line: Column) -> list[Column]:
    """128 bits for a line without its outer blanks."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2")]


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """The lines of all texts that are not blank, with `columns` and their place."""
    lines = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.btrim("line", F.lit(" \t\r")) != "")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines found on at least min_sites distinct sources."""
    lines = _lines(docs, F.col("source")).select("source", *_hashes(F.col("line")))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("sites"))
    low, high = min_sites - 1 - NEAR * min_sites, min_sites + 1 + NEAR * min_sites
    spread = materialise(spread.filter(F.col("sites") >= low), "spread")
    near = spread.filter(F.col("sites") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("source").alias("sites"))
    sure = spread.filter(F.col("sites") > high).select("h1", "h2")
    return materialise(sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines removed from text, and n_lines and n_removed.

    Lines end at newlines and compare without outer blanks; blank lines stay.
    A null source is no site.  Null texts stay null (no lines); texts that lose
    every line become empty.  Rows that repeat are cleaned alike, also with a
    null doc_id.  Other columns stay as they are.
    """
    found = boilerplate(docs, min_sites)
    small = found.count() <= BROADCAST_ROWS
    key = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash")]
    lines = _lines(docs, *key).select("id", "text_hash", "at", *_hashes(F.col("line")))
    hits = lines.join(F.broadcast(found) if small else found, ["h1", "h2"], "left_semi").groupBy("id", "text_hash").agg(F.collect_set("at").alias("gone"))
    # own columns travel in a struct, so no name of theirs can clash
    keyed = docs.select(F.struct(*docs.columns).alias("own"), F.xxhash64("text").alias("own_hash"))
    both = keyed.join(hits, (F.col("own_hash") == F.col("text_hash")) & F.col("own.doc_id").eqNullSafe(F.col("id")), "left")
    # kept places by one hash set a text, so removal is linear in its lines
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("own.text", "\n")))
    both = both.withColumn("places", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    kept = F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("own.text"))
    others = [text.alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("own.text").isNull(), 0).otherwise(F.length("own.text") - F.length(F.replace(F.col("own.text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return both.select(*others, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
