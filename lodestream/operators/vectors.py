"""Vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import rounded
from lodestream.operators import tiles

NEAREST_ROWS = 120_000  # vectors in a tile


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def semantic_score(similarity: Column) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (similarity + 1) * 50)), 2)


def unit(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with the vector scaled to length 1, once, so that pairs need a dot product only."""
    length = norm(F.col(vector))
    return rows.withColumn(vector, F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))))


def top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int = tiles.BLOCK_ROWS) -> DataFrame:
    """query_id, item_id, similarity, rank: the k most similar items of each query, exactly.

    Every block of queries meets every tile of items as products of matrices,
    and a tile hands on k items a query; ids are longs.  Rows without a vector
    are like nothing.
    """
    q = queries.filter("embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    own = items.filter("embedding is not null").select(F.col("item_id").cast("long"), "embedding")
    near = tiles.tiled(q, own, tiles.nearest(k), "query_id long, item_id long, similarity double", block_rows, NEAREST_ROWS)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def weighted_rrf(observed: DataFrame, k: int = 60) -> DataFrame:
    """key, score, n_support from rows (key, engine, variant, round, rank, engine_weight, confidence).

    The first row per key, engine, variant and round counts (lowest rank).
    """
    weight = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("engine_weight"))) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    first = observed.filter("rank >= 1 and key is not null").groupBy("key", "engine", "variant", "round").agg(F.min(F.struct("rank", weight.alias("w"))).alias("r"))
    return first.groupBy("key").agg(rounded(F.sum(F.col("r.w") / (max(1, min(k, 1000)) + F.col("r.rank"))), 8).alias("score"), F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines"), F.count(F.lit(1)).alias("n_support"))


def near_tie_order(rows: DataFrame, group: str, delta: float = 2.0, floor: float = 70.0) -> DataFrame:
    """Re-order each group's ranked list so that near ties alternate story and source.

    The choice depends on what was last put out, so one list is one sequence:
    rows (group, key, score, story, source) in rank order, bounded lists.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = pdf.sort_values(["score", "key"], ascending=[False, True]).to_dict("records")
        out: list[dict] = []
        while waiting:
            pick = 0
            if out and waiting[0]["score"] >= floor:
                last = out[-1]
                fits = (i for i in range(1, len(waiting)) if waiting[i]["score"] >= floor and waiting[0]["score"] - waiting[i]["score"] <= delta and waiting[i]["story"] != last["story"] and waiting[i]["source"] != last["source"])
                pick = next(fits, 0)
            out.append(waiting.pop(pick))
        result = pd.DataFrame(out)
        result["position"] = range(1, len(out) + 1)
        return result[[group, "key", "position"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, key {kinds['key']}, position long")
