"""Retrieval metrics and statistics over ranked lists and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.numbers import rounded


def per_query(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Metrics of each query from (query_id, item_id, rank) and its relevant (query_id, item_id).

    Fixed-K precision, recall, reciprocal rank, nDCG with binary gain, success.
    Queries without a hit count 0; without a relevant item recall and nDCG are 0.
    """
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return from_hits(hits, relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")))


def from_hits(hits: DataFrame, total: DataFrame) -> DataFrame:
    """As per_query, from ranked rows (query_id, rank, hit 0 or 1) and the number of relevant items (query_id, n_relevant)."""
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    gain = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    sums = hits.groupBy("query_id").agg(*(at(k).alias(f"h{k}") for k in (1, 3, 5, 10, 20)), *(gain(k).alias(f"g{k}") for k in (5, 10)), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    rows = sums.join(total, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))

    def ideal(k: int):
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "query_id",
        *(rounded(F.col(f"h{k}") / F.lit(float(k)), 4).alias(f"p_at_{k}") for k in (5, 10)),
        *(rounded(safe(F.col(f"h{k}"), F.col("n_relevant")), 4).alias(f"recall_at_{k}") for k in (10, 20)),
        rounded(safe(F.lit(1.0), F.col("first")), 4).alias("mrr"),
        *(rounded(F.when(F.col("n_relevant") == 0, 0.0).otherwise(F.col(f"g{k}") / ideal(k)), 4).alias(f"ndcg_at_{k}") for k in (5, 10)),
        *((F.col(f"h{k}") > 0).cast("int").alias(f"success_at_{k}") for k in (1, 3, 5)),
    )


def macro(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *(rounded(F.avg(c), 4).alias(c) for c in names))


def pair_quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs (a, b), a < b; nothing found or expected gives 1."""
    tp = found.intersect(expected).agg(F.count(F.lit(1)).alias("tp"))
    return quality_of(tp.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("n_found")))).join(F.broadcast(expected.agg(F.count(F.lit(1)).alias("n_expected")))))


def quality_of(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of rows of counts (tp, n_found, n_expected)."""
    one = F.lit(1.0)
    p, r = F.coalesce(F.try_divide("tp", "n_found"), one), F.coalesce(F.try_divide("tp", "n_expected"), one)
    rows = counts.select("tp", "n_found", "n_expected", p.alias("p"), r.alias("r"))
    return rows.select("tp", "n_found", "n_expected", rounded(F.col("p"), 4).alias("precision"), rounded(F.col("r"), 4).alias("recall"), rounded(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 4).alias("f1"))


def bootstrap(rows: DataFrame, key: str, value: str, samples: int = 2000, seed: int = 7) -> DataFrame:
    """n, mean and the 95 % interval of the mean by resampling; key tells cases apart.

    Poisson resampling: in each sample a case weighs k with the probability of
    k draws, by a digest of case, sample and seed.  A sample needs no global
    row numbers; the samples of a case are added up where the case is, so one
    row a sample leaves a task.
    """
    cases = rows.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("c"), F.col(value).cast("double").alias("v"))
    each = cases.select("c", "v", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    digest = F.md5(F.concat_ws("|", "c", F.col("s").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = F.lit(0)
    for step in poisson_steps():
        weight = weight + (u >= step).cast("int")
    means = each.withColumn("w", weight).groupBy("s").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = cases.agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return whole.join(F.broadcast(bounds)).select("n", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("q")[0], 6).alias("low"), rounded(F.col("q")[1], 6).alias("high"))


def poisson_steps(most: int = 12) -> list[float]:
    """Cumulative probabilities of 0, 1, ... draws."""
    out, p, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, samples: int = 2000, seed: int = 7) -> DataFrame:
    """As bootstrap, of the differences a - b of the cases both have: cases are drawn in pairs."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return bootstrap(both.select(key, (F.col("_a") - F.col("_b")).alias("delta")), key, "delta", samples, seed)


def returned_precision(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per query: precision over what was returned within k, and whether nothing was returned where nothing is relevant.

    ranked and relevant: query_id, item_id; every query of either counts.
    """
    hits = ranked.filter(F.col("rank") <= k).select("query_id", "item_id").join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    a = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("good"))
    r = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    both = a.join(r, "query_id", "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.select("query_id", n.alias("n_returned"), rounded(F.coalesce("good", F.lit(0)) / F.greatest(F.lit(1), n), 4).alias("precision"), ((n == 0) & F.col("n_relevant").isNull()).alias("no_result_success"))


def errors(ranked: DataFrame, relevant: DataFrame, items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, item_id, category of what the first k ranks miss or should not hold.

    items: item_id, engagement, title_words; queries: query_id, words.  A
    relevant item outside is a LEXICAL_MISS; a wrong one inside is
    ENGAGEMENT_OVERWEIGHTED from 80 on, TITLE_OVERWEIGHTED if its title holds
    all words of the query, else AMBIGUOUS_QUERY.
    """
    top = ranked.filter(F.col("rank") <= k).select("query_id", "item_id")
    missing = relevant.join(top, ["query_id", "item_id"], "left_anti").select("query_id", "item_id", F.lit("LEXICAL_MISS").alias("category"))
    return missing.unionByName(_wrong(top.join(relevant, ["query_id", "item_id"], "left_anti"), items, queries))


def _wrong(wrong: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    rows = wrong.join(items, "item_id").join(queries.select("query_id", "words"), "query_id")
    title = (F.size("words") > 0) & (F.size(F.array_except("words", "title_words")) == 0)
    kind = F.when(F.col("engagement") >= 80, "ENGAGEMENT_OVERWEIGHTED").when(title, "TITLE_OVERWEIGHTED").otherwise("AMBIGUOUS_QUERY")
    return rows.select("query_id", "item_id", kind.alias("category"))


def label_errors(ranked: DataFrame, labels: DataFrame, items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """As `errors`, where the items of the label a query wants are relevant to it, but for itself.

    ranked: query_id, item_id, rank, hit; labels: item_id, label; queries:
    query_id, wanted, words.  Each item meets the queries in its own task,
    which carry what they hold, so the pairs are neither shuffled nor sorted.
    """
    top = ranked.filter(F.col("rank") <= k)
    held = top.groupBy("query_id").agg(F.collect_list("item_id").alias("held"))
    asked = queries.select("query_id", "wanted").join(held, "query_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))
    missed = labels.join(F.broadcast(asked), (F.col("label") == F.col("wanted")) & (F.col("item_id") != F.col("query_id"))).filter(~F.array_contains("held", F.col("item_id")))
    missed = missed.select("query_id", "item_id", F.lit("LEXICAL_MISS").alias("category"))
    return missed.unionByName(_wrong(top.filter("hit = 0").select("query_id", "item_id"), items, queries))
