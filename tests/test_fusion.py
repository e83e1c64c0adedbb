import random

import numpy as np
import pytest

from lodestream.operators import fusion, tiles, vectors
from lodestream.sources.scratch import temporary


@pytest.fixture(scope="module")
def searched(spark):
    r = random.Random(5)
    words = ["a", "b", "c", "d", "é", "f"]
    texts = [(k, f"s{k % 3}", " ".join(r.choices(words, k=2)), " ".join(r.choices(words, weights=[20, 5, 3, 2, 1, 1], k=r.randint(3, 12))), f"@s{k % 3}") for k in range(300)]
    vs = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(150, 400)] + [(400, [0.0] * 4), (401, None)]
    with temporary(spark):
        indexed = fusion.index(spark.createDataFrame(texts, "item_id long, source string, title string, text string, handle string"), spark.createDataFrame(vs, "item_id long, embedding array<float>"), "source")
        asked = spark.createDataFrame([(150, vs[0][1], "a é"), (200, vs[50][1], "f"), (210, vs[60][1], None), (250, None, "zz b")], "query_id long, embedding array<float>, title string")
        queries, mean = fusion.asked(asked, indexed)
        everything = [tuple(x) for x in fusion.heads(queries, indexed, mean, 1000, 1000).select("query_id", "item_id", "bm25", "similarity").collect()]
        yield queries, indexed, mean, everything


def lists(everything):
    ranks = {}
    for place in (2, 3):
        for q in {x[0] for x in everything}:
            for n, x in enumerate(sorted((x for x in everything if x[0] == q and x[place] is not None), key=lambda x: (-x[place], x[1])), 1):
                ranks.setdefault((q, x[1]), [None, None])[place - 2] = n
    return ranks


def test_only_heads_are_handed_on_and_their_ranks_are_of_all_items(searched):
    queries, indexed, mean, everything = searched
    want = lists(everything)
    assert max(a or 0 for a, _ in want.values()) > 100 and max(b or 0 for _, b in want.values()) > 200
    got = {(r.query_id, r.item_id): [r.lexical_rank, r.semantic_rank] for r in fusion.ranked(queries, indexed, mean, 25).collect()}
    assert got == {k: v for k, v in want.items() if any(x is not None and x <= 25 for x in v)}
    assert any(b is not None and b > 25 for _, b in got.values()) and any(a is not None and a > 25 for a, _ in got.values())


def test_depth_leaves_out_nothing_that_reciprocal_ranks_put_first(searched):
    for weights, limit, k in (((0.9, 1.35), 50, 60), ((1.0, 1.0), 10, 20)):
        d = fusion.depth(weights, limit, k)
        assert sum(weights) / (k + d + 1) < min(weights) / (k + limit) - 1e-8


def test_round_robin_keeps_what_it_takes(searched):
    queries, indexed, mean, everything = searched
    rows = [tuple(x) for x in fusion.by_source(queries, indexed, mean, 4).select("query_id", "item_id", "bm25", "source").collect()]
    n_lists = sum(x[2] is not None for x in everything)
    assert len(rows) < n_lists

    def taken(rows):
        out = set()
        for q in {x[0] for x in rows}:
            of = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))
            turns, first = {}, {}
            placed = []
            for n, x in enumerate(of):
                turns[x[3]] = turns.get(x[3], 0) + 1
                placed.append((turns[x[3]], first.setdefault(x[3], n), q, x[1]))
            out |= {p[2:] for p in sorted(placed)[:4]}
        return out

    assert taken(rows) == taken([(q, i, b, f"s{i % 3}") for q, i, b, _ in everything if b is not None])


def test_rounding_of_scores_is_exact():
    x = np.array([[2.675, 0.125, 0.375, -0.125, 1e6 + 0.005, 50.005]])
    assert tiles.steps(x, 2).tolist() == [[float(f"{v:.2f}") * 100 // 1 if v < 0 else round(float(f"{v:.2f}") * 100) for v in x[0].tolist()]]


def test_a_tile_hands_on_k_items_a_query(spark):
    items = spark.range(3000).selectExpr("id as item_id", "array(cast(1 as float), cast(id % 7 as float)) as embedding")
    queries = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    near = tiles.tiled(queries, items, tiles.nearest(3), "query_id long, item_id long, similarity double")
    assert near.count() <= 60 * 3 * 3
    got = {(r.query_id, r["rank"]): r.item_id for r in vectors.top_k(queries, items, 3).collect()}
    assert all(got[q, n] == [i for i in range(q % 7, 3000, 7) if i != q][n - 1] for q in range(0, 3000, 50) for n in (1, 2, 3))


def test_ranks_are_counted_once_and_ties_kept_whole(spark, monkeypatch):
    texts = [(k, "s", f"alpha w{k % 3}", "beta beta" if k % 2 else "gamma", "@s") for k in range(40)]
    vectors_ = [(k, [1.0, float(k % 4), 0.5]) for k in range(40)]
    indexed = fusion.index(spark.createDataFrame(texts, "item_id long, source string, title string, text string, handle string"), spark.createDataFrame(vectors_, "item_id long, embedding array<float>"), "source")
    queries, mean = fusion.asked(spark.createDataFrame([(3, [1.0, 1.0, 0.5], "alpha beta"), (8, None, "w2")], "query_id long, embedding array<float>, title string"), indexed)
    made, write = [], fusion.materialise
    monkeypatch.setattr(fusion, "materialise", lambda df, what, *by: made.append(what) or write(df, what, *by))
    got = {(r.query_id, r.item_id): (r.lexical_rank, r.semantic_rank) for r in fusion.ranked(queries, indexed, mean, 5).collect()}
    assert made == ["heads", "counts"]
    every = {(r.query_id, r.item_id): (r.lexical_rank, r.semantic_rank) for r in fusion.ranked(queries, indexed, mean, 1000).collect()}
    assert got == {k: v for k, v in every.items() if min(x or 9999 for x in v) <= 5}
    # of equal scores the lowest ids, no more than asked for
    few = [(r.query_id, r.item_id) for r in fusion.heads(queries, indexed, mean, 5, 5).collect()]
    assert set(few) >= set(got) and len(few) == len(set(few))
    row, column = tiles.contenders(np.array([[3.0, 1.0, 2.9, -np.inf], [0.0, 0.0, 0.0, 0.0]]), 1, 0.2)
    assert (row.tolist(), column.tolist()) == ([0, 0, 1, 1, 1, 1], [0, 2, 0, 1, 2, 3])
    assert tiles.first(row, np.array([5, 6, 1, 4, 3, 2]), 2).tolist() == [1, 0, 3, 4]


def test_index_holds_the_words_of_index_tokens(spark):
    from pyspark.sql import functions as F

    from lodestream.functions import text

    said = ["Éclair éclair ﬁne straße STRASSE", "خبرٌ عاجل", "a_b  ćd", None, "", "plain words words"]
    rows = spark.createDataFrame([(k, "s", x, f"more {x}", "@s") for k, x in enumerate(said)], "item_id long, source string, title string, text string, handle string")
    indexed = fusion.index(rows, spark.createDataFrame([], "item_id long, embedding array<float>"), "source")
    got = {r.item_id: (r.dl, dict(zip(r.terms, r.tfs))) for r in indexed.collect()}
    for r in rows.select("item_id", *(text.index_tokens(F.col(c)).alias(c) for c in ("title", "text", "handle"))).collect():
        weights, wanted = dict(zip(("title", "text", "handle"), fusion.R.COLUMN_WEIGHTS.values())), {}
        for c, weight in weights.items():
            for w in r[c] or []:
                wanted[fusion._code(w)] = wanted.get(fusion._code(w), 0) + 2 * weight
        assert got[r.item_id] == (2 * sum(len(r[c] or []) for c in weights), wanted)
