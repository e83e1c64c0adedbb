"""Rank lists compared: judgment pools, and the choice of fusion weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import rounded
from lodestream.sources.scratch import materialise

#: Lexical weights tried, the one in use, and what a better one has to gain (fixed values).
GRID, IN_USE, GUARD = [0.25, 0.40, 0.55, 0.70], 0.25, 0.02
#: Priority of a query in Arabic script, and by uncertainty (fixed values).
ARABIC, UNSURE = 10, {"HIGH": 8, "MEDIUM": 4}


def pool(lists: dict[str, DataFrame], queries: DataFrame, depth: int = 10, quota: int | None = None) -> DataFrame:
    """What is to be judged, most telling first: query_id, item_id, the rank in every list, queue_id, priority, position.

    lists: by name, (query_id, item_id, rank); the first `depth` ranks count.
    queries: query_id, query, uncertainty.  Priority is how far the lists
    disagree on an item (depth if one list alone has it), more for queries in
    Arabic script and for unsure ones.  quota bounds what one query may add: a
    query has depth items a list at most, so its part is small by itself.
    """
    ranks = reduce(DataFrame.unionByName, (rows.filter(F.col("rank") <= depth).select("query_id", "item_id", F.lit(name).alias("list"), F.col("rank").cast("int").alias("rank")) for name, rows in lists.items()))
    wide = ranks.groupBy("query_id", "item_id").agg(*(F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists), F.max("rank").alias("high"), F.min("rank").alias("low"), F.countDistinct("list").alias("n"))
    apart = F.when(F.col("n") > 1, F.col("high") - F.col("low")).otherwise(depth)
    unsure = reduce(lambda made, kv: made.when(F.col("uncertainty") == kv[0], kv[1]), list(UNSURE.items())[1:], F.when(F.col("uncertainty") == "HIGH", UNSURE["HIGH"])).otherwise(0)
    arabic = F.when(F.coalesce(F.col("query").rlike("[\\u0600-\\u06FF]"), F.lit(False)), ARABIC).otherwise(0)
    queue = F.substring(F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("item_id").cast("string")), 256), 1, 20)
    out = wide.join(queries.select("query_id", "query", "uncertainty"), "query_id").withColumns({"queue_id": queue, "priority": apart + arabic + unsure})
    w = Window.partitionBy("query_id").orderBy(F.col("priority").desc(), "queue_id")
    out = out.withColumn("position", F.row_number().over(w))
    if quota is not None:
        out = out.filter(F.col("position") <= quota)
    return out.select("query_id", "item_id", *(f"{name}_rank" for name in lists), "queue_id", "priority", "position")


def gains(k: int) -> Column:
    """The best discounted gain of so many relevant items within k ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int")))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))


def fusion_weights(scored: DataFrame, queries: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """query_class, weight, ndcg, precision, chosen: every weight's mean quality by class, and the one to take.

    scored: query_id, item_id, lexical, semantic, hit; queries: query_id,
    query_class, n_relevant.  All weights are ranked in one pass: an item's
    scores are one array, its entries dealt to (query, weight), where ten are
    kept before the shuffle.  A weight is taken in place of IN_USE if it gains
    GUARD in nDCG@10 and loses nothing in precision at five; of several the
    best, by nDCG, precision, then nearness to IN_USE.
    """
    fused = F.array(*(F.struct(F.lit(w).alias("weight"), rounded(w * F.col("lexical") + (1 - w) * F.col("semantic"), 6).alias("score")) for w in grid))
    each = scored.select("query_id", "item_id", "lexical", "hit", F.explode(fused).alias("f")).select("query_id", "item_id", "lexical", "hit", "f.*")
    w = Window.partitionBy("query_id", "weight").orderBy(F.col("score").desc(), F.col("lexical").desc(), F.col("item_id").desc())
    top = each.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    got = top.groupBy("query_id", "weight").agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("gain"), F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("good"))
    own = got.join(queries, "query_id").withColumns({"ndcg": F.when(F.col("n_relevant") > 0, F.col("gain") / gains(10)).otherwise(0.0), "precision": F.col("good") / 5})
    means = own.groupBy("query_class", "weight").agg(rounded(F.avg("ndcg"), 6).alias("ndcg"), rounded(F.avg("precision"), 6).alias("precision"))
    means = materialise(means, "means")
    rank = F.struct("ndcg", "precision", -rounded(F.abs(F.col("weight") - IN_USE), 6), -F.col("weight"))
    best = means.groupBy("query_class").agg(F.max_by(F.struct("weight", "ndcg", "precision"), rank).alias("best"), F.max(F.when(F.col("weight") == IN_USE, F.struct("ndcg", "precision"))).alias("used"))
    better = (F.col("best.ndcg") >= rounded(F.col("used.ndcg") + GUARD, 6)) & (F.col("best.precision") >= F.col("used.precision"))
    chosen = best.select("query_class", F.when(better, F.col("best.weight")).otherwise(IN_USE).alias("take"))
    return means.join(chosen, "query_class").select("query_class", "weight", "ndcg", "precision", (F.col("weight") == F.col("take")).alias("chosen"))
