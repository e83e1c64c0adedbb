"""URL filters: rules by host and path, then a blocked Bloom filter in front of an exact join.

The listed canonical URLs become a table of 512-bit blocks, one row a block:
a key picks one block and eight bits in it, and blocks merge by bit_or in an
ordinary aggregation.  The block table is broadcast and every page is probed
in the scan, before any shuffle; only what passes (listed pages and a small
share of false positives) meets the exact keys.  Those are broadcast too while
their number stays under a bound.  Beyond the bounds the distinct keys of the
pages, combined map side, probe a shuffled block table, and hits are copied
over salts, so that a url in a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
BROADCAST_ROWS = 500_000  # of at most about 80 bytes each
SALTS = 16
#: (action, host, path), as the contract of the query fixes them
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end; A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without a trailing slash; scheme, query and fragment go."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and starts the path: (rule, action)."""
    names, actions = [], []
    for action, rule_host, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        names.append(F.when(fits, F.lit(rule_host + start)))
        actions.append(F.when(fits, F.lit(action)))
    if not names:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.coalesce(*names), F.coalesce(*actions)


def _place(key: str, blocks: int) -> list[Column]:
    """Block number and the eight words of one key: a bit in each."""
    words = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64('bits', {key}), {6 * i}) & 63 as int))").alias(f"w{i}") for i in range(8)]
    return [F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block"), *words]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The block table of the distinct values of `key`; only blocks with bits set have rows."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // 512))
    rows = keys.select("key", *_place("key", blocks))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"f{i}") for i in range(8))), blocks


def probe(rows: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """rows (with `key`) and `maybe`: whether the broadcast block table passes the key."""
    names = [f"w{i}" for i in range(8)]
    placed = rows.select("*", *_place("key", blocks))
    found = placed.join(F.broadcast(table), "block", "left")
    passes = " and ".join(f"(w{i} & f{i}) <> 0" for i in range(8))
    return found.withColumn("maybe", F.coalesce(F.expr(passes), F.lit(False))).drop("block", *names, *(f"f{i}" for i in range(8)))


def listed(rows: DataFrame, urls: DataFrame, url: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (with `key`) and `listed`: whether the key is a canonical key of the list (`urls.url`)."""
    keys = urls.select(canonical(F.col(url)).alias("key")).filter("key <> ''").distinct()
    n = keys.count()
    table, blocks = build_filter(keys, n)
    small = n <= broadcast_rows
    exact = keys.withColumn("listed", F.lit(True))
    if blocks <= broadcast_rows:
        probed = probe(rows, table, blocks)
        if small:  # no shuffle at all: an empty key stands for what the filter stopped
            found = probed.withColumn("key", F.when(F.col("maybe"), F.col("key")).otherwise("")).join(F.broadcast(exact), "key", "left")
            return found.drop("maybe").withColumn("listed", F.coalesce("listed", F.lit(False)))
        hits = probed.filter("maybe").select("key").distinct().join(keys, "key", "left_semi")
    else:
        placed = rows.select("key").filter("key <> ''").distinct().select("key", *_place("key", blocks))
        passes = " and ".join(f"(w{i} & f{i}) <> 0" for i in range(8))
        hits = placed.join(table, "block").filter(passes).select("key").join(keys, "key", "left_semi")
        probed = rows.withColumn("maybe", F.lit(True))
    hits = hits.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("listed"))
    # the salt of a row the filter stopped is its own, outside the hits' range, so such rows spread as well
    salt = F.when(F.col("maybe"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise((SALTS + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).cast("int"))
    found = probed.withColumn("salt", salt).join(hits, ["key", "salt"], "left")
    return found.drop("maybe", "salt").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, urls: DataFrame, rules=RULES, default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest fitting rule decides.  Without one, a page whose canonical URL
    is listed is blocked and the rest get `default`.  Null urls and urls
    without :// have an empty host and path, fit no rule and are never listed.
    Rows that repeat are judged alike; other columns stay.
    """
    made = ("host", "path", "rule", "verdict")
    # own columns travel in a struct, so no name of theirs can clash; made ones are replaced
    rows = pages.select(F.struct(*pages.columns).alias("own"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.coalesce(canonical(F.col("url")), F.lit("")).alias("key"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    verdict = F.coalesce("action", F.when(F.col("listed"), F.lit("block")), F.lit(default))
    joined = listed(rows, urls, broadcast_rows=broadcast_rows).withColumn("verdict", verdict)
    return joined.select(*(F.col(f"own.`{c}`").alias(c) for c in pages.columns if c not in made), *made)
