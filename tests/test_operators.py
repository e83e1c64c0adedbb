"""Operators against hand-computed values and plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import aggregates, clustering, dedup, graph, metrics, planning, retrieval, vectors, writes
from lodestream.sources import exports, payloads
from lodestream.sources.scratch import materialise


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_final_score_of_the_worked_example(spark):
    parts = {"relevance": F.lit(100.0), "freshness": F.lit(100.0), "engagement": F.lit(50.0), "source_confidence": F.lit(80.0), "cross_source": F.lit(40.0), "novelty": F.lit(100.0)}
    assert spark.range(1).select(retrieval.final_score(parts, F.lit(0.0))).first()[0] == pytest.approx(84.5)
    with pytest.raises(ValueError):
        retrieval.final_score(parts, F.lit(0.0), retrieval.WEIGHTS | {"novelty": 0.5})


def test_candidates_need_the_phrase_or_enough_words(spark):
    docs = retrieval.tokenised(spark.createDataFrame([(1, "public policy", "news about public policy"), (2, "policy", "public works"), (3, "", "none")], "item_id int, title string, text string"))
    ids = lambda q: rows(retrieval.candidates(docs, q), "item_id")
    assert ids(retrieval.Query(("public", "policy"))) == [(1,), (2,)]
    assert ids(retrieval.Query(("public", "policy"), exact=True)) == [(1,)]
    assert ids(retrieval.Query(())) == []
    assert retrieval.Query(("a", "b", "c", "d")).required == 3


def test_bm25_prefers_title_and_rare_terms(spark):
    docs = [(k, "x", "common " * 5) for k in range(8)] + [(8, "rare", "common"), (9, "x", "rare common common common")]
    found = retrieval.bm25(spark.createDataFrame(docs, "item_id int, title string, text string"), spark.createDataFrame([(0, "rare"), (0, "common")], "query_id int, term string"))
    best = [r.item_id for r in found.orderBy(F.col("bm25").desc()).collect()]
    assert best[:2] == [8, 9] and len(best) == 10


def test_fair_admission_interleaves_and_drops_copies(spark):
    data = [(k, "a" if k < 6 else "b", float(-k), k if k != 7 else 0) for k in range(9)]
    got = retrieval.fair_admission(spark.createDataFrame(data, "item_id int, source string, score double, ident int"), "source", [F.col("score").desc()], ["ident"], 3, 5)
    assert [(r.item_id, r.source_rank) for r in got.collect()] == [(0, 1), (6, 1), (1, 2), (8, 2), (2, 3)]


def test_time_buckets_take_both_ends_and_fill_gaps(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    e = spark.createDataFrame([(x,) for x in ("2024-01-01 00:00:00", "2024-01-01 05:00:00", "2024-01-02 00:00:00", "2023-12-31 00:00:00", None)], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    got = aggregates.time_buckets(e, "ts", t("2024-01-01 00:00:00"), t("2024-01-02 00:00:00"), 4)
    assert rows(got, "bucket", "n_rows") == [(0, 2), (1, 0), (2, 0), (3, 1)]
    trend = aggregates.trend(spark.createDataFrame([(0, 0), (1, 3)], "bucket long, n_rows long"), 2).first()
    assert trend.trend == 100.0
    assert aggregates.trend(spark.createDataFrame([(0, 2), (1, 3)], "bucket long, n_rows long"), 2).first().trend == 50.0


def test_histogram_funnel_latest(spark):
    s = spark.createDataFrame([(0.0,), (19.9,), (20.0,), (100.0,)], "score double")
    assert rows(aggregates.score_histogram(s, "score"), "band", "n") == [(0, 2), (20, 1), (40, 0), (60, 0), (80, 1)]
    a, b = spark.createDataFrame([("p",), ("p",), ("q",)], "k string"), spark.createDataFrame([("r",)], "k string")
    assert rows(aggregates.funnel({"x": a, "y": b}, ["k"]), "k", "x", "y") == [("p", 2, 0), ("q", 1, 0), ("r", 0, 1)]
    got = aggregates.latest(spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, None)], "k int, t int, v string"), ["k"], "t", "v")
    assert rows(got, "k", "t", "v", "n") == [(1, 3, "c", 2), (2, 2, None, 1)]


def test_vector_scores_and_top_k_in_blocks(spark):
    r = random.Random(1)
    vs = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(40)] + [(40, [0.0] * 8)]
    frame = spark.createDataFrame(vs, "item_id long, embedding array<float>")
    queries = frame.filter("item_id < 6").withColumnRenamed("item_id", "query_id")
    whole = rows(vectors.top_k(queries, frame, 5), "query_id", "item_id", "similarity", "rank")
    assert whole == rows(vectors.top_k(queries, frame, 5, block_rows=2), "query_id", "item_id", "similarity", "rank")
    assert len(whole) == 30 and all(q != i for q, i, _, _ in whole)
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), vectors.semantic_score(F.lit(1.2))).first()[:] == (0.0, 100.0)


def test_rrf_counts_the_first_of_each_list(spark):
    seen = spark.createDataFrame([("u", "e1", "v", 1, 1, 1.0, 1.0), ("u", "e1", "v", 1, 9, 1.0, 1.0), ("u", "e2", "v", 1, 2, 3.0, 1.0), ("w", "e1", "v", 1, 2, 1.0, 0.5), (None, "e1", "v", 1, 1, 1.0, 1.0), ("z", "e1", "v", 1, 0, 1.0, 1.0)], "key string, engine string, variant string, round int, rank int, engine_weight double, confidence double")
    got = {r.key: (r.score, r.n_support) for r in vectors.weighted_rrf(seen).collect()}
    assert got == {"u": (pytest.approx(1 / 61 + 2 / 62, abs=1e-8), 2), "w": (pytest.approx(0.5 / 62, abs=1e-8), 1)}


def test_near_ties_alternate(spark):
    data = [(0, k, s, st, so) for k, s, st, so in [(1, 90.0, 1, "a"), (2, 89.5, 1, "a"), (3, 89.0, 2, "b"), (4, 60.0, 3, "c")]]
    got = vectors.near_tie_order(spark.createDataFrame(data, "query_id int, key long, score double, story int, source string"), "query_id")
    assert [r.key for r in got.orderBy("position").collect()] == [1, 3, 2, 4]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(["n1", "r1", "n2", "r2", "n3", "r3"])], "query_id int, item_id string, rank int")
    relevant = spark.createDataFrame([(0, x) for x in ("r1", "r2", "r3")], "query_id int, item_id string")
    m = metrics.per_query(ranked, relevant).first()
    assert (m.p_at_5, m.mrr, m.ndcg_at_5, m.success_at_1, m.success_at_3) == (0.4, 0.5, pytest.approx(0.4982), 0, 1)
    pairs = lambda *p: spark.createDataFrame(p, "a int, b int")
    q = metrics.pair_quality(pairs((1, 2), (1, 3)), pairs((1, 2), (4, 5), (6, 7))).first()
    assert (q.tp, q.precision, q.recall, q.f1) == (1, 0.5, pytest.approx(0.3333), 0.4)
    b = metrics.bootstrap(spark.createDataFrame([(k, k % 2) for k in range(200)], "k int, v int"), "k", "v", samples=200).first()
    assert b.mean == 0.5 and 0.38 < b.low < 0.47 and 0.53 < b.high < 0.62


def test_every_missed_item_of_a_label_is_listed(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(40, None)], "item_id long, label int")
    ranked = spark.createDataFrame([(0, 2, 1, 1), (0, 3, 2, 0), (0, 4, 6, 1)], "query_id long, item_id long, rank int, hit int")
    items = spark.createDataFrame([(3, 90.0, ["x"])], "item_id long, engagement double, title_words array<string>")
    queries = spark.createDataFrame([(0, 0, ["x"]), (7, 1, ["x"])], "query_id long, wanted int, words array<string>")
    got = rows(metrics.label_errors(ranked, labels, items, queries), "query_id", "item_id", "category")
    missed = [(0, k) for k in range(4, 40, 2)] + [(7, k) for k in range(1, 40, 2) if k != 7]
    assert got == sorted([(q, k, "LEXICAL_MISS") for q, k in missed] + [(0, 3, "ENGAGEMENT_OVERWEIGHTED")])


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(500, 500)]
    r.shuffle(edges)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 140)) and 500 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    r, sets = random.Random(2), []
    for g in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(40)]
        for k in range(6):
            s = set(base)
            for _ in range(r.randrange(0, 6)):
                s.discard(r.choice(base))
                s.add(f"e{r.randrange(10**6)}")
            sets.append((g * 10 + k, sorted(s)))
    sets += [(90, sets[0][1]), (91, []), (92, ["solo"]), (93, ["solo"])]
    frame = spark.createDataFrame(sets, "item_id long, items array<string>")
    low = {}
    for i, s in sets:
        if s:
            low.setdefault(tuple(s), i)
    classes = [(i, set(s)) for s, i in low.items()]
    want = sorted((a, b) if a < b else (b, a) for (a, x), (b, y) in itertools.combinations(classes, 2) if 100 * len(x & y) >= 78 * len(x | y))
    assert rows(dedup.similar_pairs(frame), "a", "b") == want
    assert dict(rows(dedup.class_members(frame), "item_id", "class_id"))[90] == 0


def test_whole_sets_meet_for_likely_pairs_only(spark, monkeypatch):
    met = {}
    monkeypatch.setattr(dedup, "materialise", lambda df, what, *by: met.setdefault(what, materialise(df, what, *by)))
    own = lambda k: [f"{k}-{j}" for j in range(300)]
    sets = [(k, [*(f"both-{j}" for j in range(20)), *own(k)]) for k in range(12)] + [(20 + k, [*own("x"), f"only-{k}"]) for k in range(3)]
    got = dedup.similar_pairs(spark.createDataFrame(sets, "item_id long, items array<string>"))
    assert rows(got, "a", "b", "shared", "n_union") == [(20, 21, 300, 302), (20, 22, 300, 302), (21, 22, 300, 302)]
    assert met["near"].count() == 3


def test_words_with_equal_short_codes_stay_whole():
    several, words = np.array([7], np.int32), [[7 << 32 | 1, 7 << 32 | 2, 9 << 32], [], [-5]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])
    got = next(dedup._coded(several)(iter([batch])))
    assert got.to_pydict() == {"item_id": [1, 2, 3], "codes": [[9], [], [-1]], "words": [words[0][:2], [], []]}


def test_every_document_of_a_copy_group_is_reported(spark):
    r = random.Random(21)
    base = [[f"w{k}" for k in r.sample(range(40), 20)] for _ in range(4)]
    near = [[*base[0][1:], "other"], [*base[0][2:], "more", "two"]]
    sets = {k: s for k, s in enumerate([*base, *near, *[base[0]] * 5, *[base[3]] * 7, *[near[0]] * 2, [], []])}
    frame = spark.createDataFrame(list(sets.items()), "item_id long, items array<string>")
    got = rows(dedup.document_links(frame), "item_id", "class_id", "n_copies", "n_links")
    want = []
    for k, s in sets.items():
        copies = [j for j, t in sets.items() if s and set(t) == set(s)] or [k]
        links = [j for j, t in sets.items() if j != k and s and 100 * len(set(s) & set(t)) >= 78 * len(set(s) | set(t))]
        want.append((k, min(copies), len(copies) - 1, len(links)))
    assert got == want


def test_shifted_windows_do_not_chain(spark):
    words = [f"t{k}" for k in range(14)]
    sets = spark.createDataFrame([(1, words[0:10]), (2, words[1:11]), (3, words[2:12])], "item_id long, items array<string>")
    pairs = dedup.similar_pairs(sets).withColumn("score", F.col("shared") / F.col("n_union"))
    assert rows(pairs, "a", "b") == [(1, 2), (2, 3)]
    assert rows(dedup.complete_linkage(pairs), "id", "cluster") == [(1, 1), (2, 1), (3, 3)]


def plain_linkage(pairs, key):
    """Clusters by the definition: items in order, each joins the whole cluster with the strongest weakest pair."""
    score = {frozenset(p[:2]): p[2] for p in pairs}
    clusters, admitted = [], {}
    for item in sorted({i for p in pairs for i in p[:2]}, key=lambda i: (key[i], i)):
        fits = [(min(score[frozenset((item, m))] for m in c), -n) for n, c in enumerate(clusters) if all(frozenset((item, m)) in score for m in c)]
        if fits:
            weakest, n = max(fits)
            clusters[-n].append(item)
        else:
            weakest = 1.0
            clusters.append([item])
        admitted[item] = weakest
    return sorted((m, c[0], admitted[m]) for c in clusters for m in c)


@pytest.mark.parametrize("seed,n,share", [(1, 12, 0.5), (2, 40, 0.15), (3, 30, 0.8), (4, 60, 0.05), (5, 25, 1.0)])
def test_complete_linkage_equals_its_definition(spark, seed, n, share):
    r = random.Random(seed)
    pairs = [(a, b, r.choice([0.8, 0.85, 0.9, 1.0])) for a in range(n) for b in range(a + 1, n) if r.random() < share]
    key = {i: r.choice("abc") for i in range(n)}
    frame = spark.createDataFrame(pairs, "a long, b long, score double").repartition(5)
    order = spark.createDataFrame(list(key.items()), "item_id long, key string")
    assert rows(dedup.complete_linkage(frame, order=order), "id", "cluster", "admitted") == plain_linkage(pairs, key)
    assert rows(dedup.complete_linkage(frame), "id", "cluster", "admitted") == plain_linkage(pairs, dict.fromkeys(key, ""))
    assert dedup.complete_linkage(frame.limit(0)).count() == 0


def test_linkage_of_a_long_chain_and_a_large_clique(spark):
    chain = spark.range(3000).selectExpr("id as a", "id + 1 as b", "0.9D as score")
    found = dedup.complete_linkage(chain).groupBy("cluster").count().collect()
    assert len(found) == 1501 and max(x["count"] for x in found) == 2
    ids = spark.range(300)
    clique = ids.alias("x").join(ids.alias("y"), F.expr("x.id < y.id")).selectExpr("x.id as a", "y.id as b", "0.9D as score")
    assert rows(dedup.complete_linkage(clique).groupBy("cluster").count(), "cluster", "count") == [(0, 300)]


def test_key_groups_and_canonical_member(spark):
    data = spark.createDataFrame([(1, "u1", "f1"), (2, "u1", "f2"), (3, "u2", "f2"), (4, "u9", "f9"), (5, None, "f9")], "item_id long, u string, f string")
    assert rows(dedup.by_keys(data, "u", "f"), "item_id", "group_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_temporal_neighbours_equal_brute_force(spark):
    r = random.Random(6)
    data = [(k, r.choice(["en", "de"]), r.randrange(0, 20 * 86400)) for k in range(150)] + [(900, "en", None), (901, "de", None)]
    frame = spark.createDataFrame(data, "item_id long, language string, s long").select("item_id", "language", F.timestamp_seconds("s").alias("published_at"))
    got = rows(clustering.temporal_neighbours(frame, F.col("language") == "en", F.col("language") == "de", k=4), "item_id", "n", "other_id")
    want = []
    for i, lang, at in data:
        if lang == "en" and at is not None:
            near = sorted((abs(at - t), o) for o, other, t in data if other == "de" and t is not None and abs(at - t) <= 3 * 86400)[:4]
            want += [(i, n + 1, o) for n, (_, o) in enumerate(near)]
    assert got == sorted(want)


def test_temporal_neighbours_decide_ties_by_id(spark):
    r = random.Random(16)
    data = [(k, "de", 36000) for k in range(1, 501)] + [(1000, "en", 39600), (1001, "en", 36000), (1002, "en", 32400)]
    data += [(2000 + k, r.choice(["en", "de", "both"]), 864_000 + 60 * r.choice([0, 1, 2, 3, 90])) for k in range(400)]
    frame = spark.createDataFrame(data, "item_id long, language string, s long").select("item_id", "language", F.timestamp_seconds("s").alias("published_at"))
    got = rows(clustering.temporal_neighbours(frame, F.col("language") != "de", F.col("language") != "en", k=12), "item_id", "n", "other_id", "gap_seconds")
    want = []
    for i, lang, at in data:
        if lang != "de":
            near = sorted((abs(at - b), j) for j, other, b in data if other != "en" and j != i and abs(at - b) <= 3 * 86400)[:12]
            want += [(i, n + 1, j, float(g)) for n, (g, j) in enumerate(near)]
    assert [x[2] for x in got if x[0] == 1000] == list(range(1, 13))
    assert got == sorted(want)


def test_story_evidence_needs_identity(spark):
    story = "earthquake shakes coastal village monday rescue teams search collapsed school building"
    docs = [(1, "coastal village earthquake", story), (2, "village earthquake coastal", story + " overnight")] + [(10 + k, f"other{k} topic{k}", f"unrelated{k} words{k} only{k} here{k}") for k in range(8)]
    content = spark.createDataFrame([(*d, "s", "en") for d in docs], "item_id long, title string, text string, source string, language string").withColumn("published_at", F.lit(None).cast("timestamp"))
    feats = clustering.features(content.withColumn("canonical_url", F.concat(F.lit("https://e.org/"), "item_id")))
    each = clustering.terms(feats)
    pairs = clustering.block_pairs(feats, each)
    assert rows(pairs, "a", "b") == [(1, 2)]
    assert clustering.evidence(feats, each, pairs).first().same_story


def test_planning_rules(spark):
    c = spark.createDataFrame([(1, f"s{k % 3}", 0.8, "e", k % 2, 60.0, 50.0) for k in range(12)] + [(2, "s", 0.1, "e", 0, 90.0, 10.0)], "q int, source string, completeness double, engine string, variant int, lexical double, semantic double")
    assert rows(planning.uncertainty(c, "q"), "q", "level") == [(1, "LOW"), (2, "HIGH")]
    lit = F.lit
    gain = spark.range(1).select(planning.gain(lit(3), lit(2), lit(1), lit(0), lit(0), lit(4), lit(0.0))).first()[0]
    assert gain == pytest.approx(__import__("math").log1p(8) / 4)
    reasons = [planning.stop_reason(lit(lv), lit(g), lit(n), 20, lit(r), 3, lit(u)) for lv, g, n, r, u in [("HIGH", 1.0, 20, 1, 1), ("LOW", 1.0, 10, 1, 1), ("HIGH", 0.1, 3, 2, 1), ("HIGH", 1.0, 3, 1, 1), ("HIGH", 1.0, 3, 3, 1), ("HIGH", 1.0, 3, 1, 0)]]
    assert spark.range(1).select(*(r.alias(f"r{i}") for i, r in enumerate(reasons))).first()[:] == ("USER_LIMIT", "SATISFIED", "LOW_MARGINAL_GAIN", None, "MAX_ROUNDS", "SOURCE_EXHAUSTION")
    outcomes = [planning.outcome(lit(n), lit(code), lit(done)) for n, code, done in [(1, None, True), (0, "captcha_blocked", False), (0, "timeout", False), (0, None, True), (0, "odd", True)]]
    assert spark.range(1).select(*(o.alias(f"o{i}") for i, o in enumerate(outcomes))).first()[:] == ("RESULT", "BLOCKED", "UNAVAILABLE", "NO_RESULT", "ERROR")


def test_merges(spark):
    cur = spark.createDataFrame([(1, "t1", 5), (2, "t2", None)], "k int, title string, likes int")
    new = spark.createDataFrame([(2, "changed", 7), (3, "t3", 1)], "k int, title string, likes int")
    assert rows(writes.upsert(cur, new, ["k"], ["title"], ["likes"]), "k", "title", "likes") == [(1, "t1", 5), (2, "t2", 7), (3, "t3", 1)]
    assert rows(writes.insert_absent(cur, new, ["k"]), "k", "title") == [(1, "t1"), (2, "t2"), (3, "t3")]
    assert rows(writes.delete_cascade(new, cur, "k"), "k") == [(2,)]
    assert sorted((r.k, r.likes) for r in writes.set_null(new.select("k", "likes"), cur.select(F.lit(7).alias("likes")).distinct(), "likes", "likes").collect()) == [(2, 7), (3, None)]
    assert rows(writes.orphans(new, cur, "k", "k"), "k") == [(3,)]
    edges = writes.merge_edges(spark.createDataFrame([("a", "b", 2)], "l string, r string, support long"), spark.createDataFrame([("a", "b"), ("a", "c")], "l string, r string"), ["l", "r"])
    assert rows(edges, "l", "r", "support") == [("a", "b", 3), ("a", "c", 1)]


PAYLOADS = {
    "x": ('{"id":"5","text":"hi #Tag","created_at":"2024-01-02T03:04:05Z","user":{"username":"ann"},"public_metrics":{"like_count":"3"},"entities":{"hashtags":[{"tag":"Tag"}]}}', "https://x.com/ann/status/5", {"likes": 3.0}),
    "reddit": ('{"id":"r1","title":"T","selftext":"","permalink":"/r/a/comments/r1","created_utc":1704164645,"score":4}', "https://www.reddit.com/r/a/comments/r1", {"score": 4.0}),
    "telegram": ('{"id":"7","message":"m","date":"1704164645","channel":{"username":"c"},"reactions":[{"count":2},{"count":3}]}', "https://t.me/c/7", {"reactions": 5.0}),
    "bluesky": ('{"uri":"at://d/app/abc","author":{"handle":"h.b"},"record":{"text":"t","createdAt":"2024-01-02T03:04:05Z","facets":[{"features":[{"tag":"q"},{"uri":"u"}]}]},"likeCount":1}', "https://bsky.app/profile/h.b/post/abc", {"likes": 1.0}),
    "hacker_news": ('{"objectID":"9","story_title":"S","comment_text":"<p>a &amp; b","created_at":"2024-01-02T03:04:05Z","points":null}', "https://news.ycombinator.com/item?id=9", {}),
    "github": ('{"id":"1","html_url":"https://github.com/a/b","full_name":"a/b","description":"d","created_at":"2024-01-02T03:04:05Z","stargazers_count":9,"owner":{"login":"a"}}', "https://github.com/a/b", {"stars": 9.0}),
    "gdelt": ('{"url":"https://n.example/x","title":"N","seendate":"20240102T030405Z"}', "https://n.example/x", {}),
    "rss": ('{"guid":"g","link":"https://f.example/1","title":"F","description":"<b>x</b>","pubDate":"Tue, 02 Jan 2024 03:04:05 +0000"}', "https://f.example/1", {}),
    "youtube": ('{"id":{"videoId":"v"},"snippet":{"title":"V","description":"","publishedAt":"2024-01-02T03:04:05Z"},"statistics":{"viewCount":"8"}}', "https://www.youtube.com/watch?v=v", {"views": 8.0}),
    "mastodon": ('{"id":"1","url":"https://m.example/w","content":"","reblog":{"id":"2","url":"https://m.example/2","content":"<p>boost</p>","created_at":"2024-01-02T03:04:05Z","account":{"acct":"z"},"favourites_count":6}}', "https://m.example/2", {"likes": 6.0}),
    "instagram": ('{"id":"i","permalink":"https://ig.example/p","caption":"c #a","timestamp":"2024-01-02T03:04:05Z","like_count":2}', "https://ig.example/p", {"likes": 2.0}),
    "tiktok": ('{"id":"t","username":"u","video_description":"d","create_time":"1704164645","view_count":5}', "https://www.tiktok.com/@u/video/t", {"views": 5.0}),
    "threads": ('{"id":"h","text":"t","permalink":"https://th.example/h","timestamp":"2024-01-02T03:04:05Z","username":"u"}', "https://th.example/h", {}),
}


@pytest.mark.parametrize("platform", sorted(payloads.PLATFORMS))
def test_payloads_become_content_rows(spark, platform):
    payload, url, numbers_ = PAYLOADS[platform]
    frame = spark.createDataFrame([(payload,), ("{broken",), ("{}",), (None,)], "payload string")
    got = payloads.normalise(frame, platform).select("*", F.unix_seconds("published_at").alias("at")).collect()
    assert len(got) == 1 and got[0].url == url and (got[0].metrics or {}) == numbers_ and got[0].at == 1704164645
    counts = payloads.stage_counts(frame, platform, []).first()
    assert (counts.raw, counts.schema_valid, counts.malformed) == (4, 1, 3)


def test_other_sources(spark):
    assert payloads.mock(spark, "q").count() == 5 and payloads.registry(spark).filter("not searchable").count() == 2
    kinds = {u: k for u, k in [("https://twitter.com/a/status/1", "POST"), ("https://old.reddit.com/r/x/comments/1/t/c", "COMMENT"), ("https://www.threads.net/@a", "PROFILE"), ("https://x.com/a/b/c", "OTHER"), ("https://e.org", None)]}
    frame = spark.createDataFrame([(u,) for u in kinds], "u string").select("u", payloads.classify(F.col("u")).alias("k"))
    assert dict(rows(frame.fillna("-"), "u", "k")) == {u: k or "-" for u, k in kinds.items()}
    index = spark.createDataFrame([("https://e.org/a?utm_x=1", "20240102030405"), ("https://e.org/b", "20240102030405")], "url string, timestamp string")
    assert payloads.captures(index, "https://E.org/a/", 5).count() == 1
    web = spark.createDataFrame([("https://e.org/a", "T", "v", 1, 3, ["g", "b"])], "url string, title string, variant string, round int, position int, engines array<string>")
    assert payloads.discovered(web).count() == 2
    posts = spark.createDataFrame([("1", "u1"), ("2", None)], "id string, author_id string")
    assert rows(payloads.with_authors(posts, spark.createDataFrame([("u1", "N", "n")], "id string, name string, username string")).fillna("-"), "id", "username") == [("1", "n"), ("2", "-")]


def test_exports(spark, tmp_path):
    frame = spark.createDataFrame([(1, "=cmd", ["a", "b"])], "i int, t string, tags array<string>")
    exports.write_csv(frame, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[:] == ("1", "'=cmd", "a|b")
    exports.write_json(frame, str(tmp_path / "j"))
    assert '"schema_version":"1.0"' in spark.read.text(str(tmp_path / "j")).first()[0]
    assert exports.event_frames(spark.createDataFrame([(3, "done", None)], "sequence int, event string, data string")).first()[0] == "id: 3\nevent: done\ndata: {}\n\n"


def test_text_functions_ignore_partitioning(spark):
    frame = spark.createDataFrame([(k, f"Word{k} über {k}") for k in range(50)], "k int, t string")
    a = rows(frame.repartition(7).select("k", F.array_join(text.tokens(F.col("t")), " ").alias("w")), "k", "w")
    assert a == rows(frame.coalesce(1).select("k", F.array_join(text.tokens(F.col("t")), " ").alias("w")), "k", "w")


def test_degree_cap_equals_the_sequential_walk(spark):
    import random

    r = random.Random(6)
    pairs = {tuple(sorted(r.sample(range(40), 2))): r.randrange(4) for _ in range(500)}
    count, want = {}, set()
    for (a, b), p in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if count.get(a, 0) < 5 and count.get(b, 0) < 5:
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
            want.add((a, b))
    frame = spark.createDataFrame([(*k, p) for k, p in pairs.items()], "a long, b long, p int")
    for tail in (0, 1_000):
        got = clustering.capped(frame, [-F.col("p"), F.col("a"), F.col("b")], degree=5, tail=tail)
        assert {(x.a, x.b) for x in got.collect()} == want and got.count() == len(want)


def test_degree_cap_takes_few_tables_on_a_chain(spark, monkeypatch):
    made = []
    monkeypatch.setattr(clustering, "materialise", lambda df, what, *by: made.append(what) or materialise(df, what, *by))
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = clustering.capped(chain, [F.col("a"), F.col("b")], degree=1, tail=100)
    assert rows(got, "a", "b") == [(k, k + 1) for k in range(0, 400, 2)]
    assert len(made) <= 8


def test_cosines_of_candidate_pairs(spark, tmp_path):
    from lodestream.plans.dedup import _cosines

    spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert [(a, b, round(s, 6)) for a, b, s in rows(_cosines(spark, str(tmp_path), pairs), "a", "b", "semantic")] == [(1, 2, 0.96), (1, 4, 0.0)]


def test_representatives_and_entities(spark):
    data = [(1, "A title", "one two three", "https://e.org/a"), (2, "", "A title one two three", "https://e.org/b"), (3, "A title", "one two three", "https://e.org/c"), (4, "Longer title", "words words words here", "https://e.org/a?utm_source=x"), (5, None, "", "https://e.org/d")]
    got = clustering.representatives(spark.createDataFrame(data, "item_id long, title string, text string, canonical_url string")).collect()
    assert {x.item_id: x.rep_id for x in got} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 5}
    names = spark.range(1).select(clustering.entities(F.lit("The World-Bank met Éric and OpenAI in Paris_Nord, Example (UN) new York."), ["paris"]).alias("e")).first().e
    assert names == ["world-bank", "openai", "paris_nord", "york"]


def test_results_of_one_query_are_not_dealt_by_it(spark):
    from lodestream.operators import lattice

    queries = spark.createDataFrame([(1, "solar plant", False)], "query_id long, original string, closed boolean")
    found = spark.createDataFrame([(1, f"s{k % 2}:{k}", "Turbine-9 near the plant") for k in range(4)], "query_id long, result_id string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lattice.expansions(queries, found)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got, "term", "n_results", "n_sources") == [("near", 4, 2), ("turbine-9", 4, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_meet_as_packed_lists(spark):
    from lodestream.operators.clustering import _met, _packed, _unpacked

    lists = [[5, 0, 300, 2**34 + 1], None, [], [7], list(range(0, 40_000, 12))]
    made = _packed(pa.array(lists, pa.list_(pa.int64())))
    row, number = _unpacked(made)
    assert [sorted(x or []) for x in lists] == [number[row == k].tolist() for k in range(5)] and len(made[4].as_py()) == 3_334
    other = _packed(pa.array([[4, 303], [1], None, [6], [13, 25, 29]], pa.list_(pa.int64())))
    assert [x.tolist() for x in _met(made, other, 2)] == [[0, 0, 3, 4, 4], [1, 75, 1, 3, 6], [5, 300, 7, 12, 24], [4, 303, 6, 13, 25]]
    # a pair's shared words are no rows, and its strings do not travel
    content = spark.createDataFrame([(k, f"Alpha Beta {k % 2}", f"Alpha Beta gamma{k % 3} delta{k}", "s", "en", f"https://e.org/{k}") for k in range(6)], "item_id long, title string, text string, source string, language string, canonical_url string").withColumn("published_at", F.lit(None).cast("timestamp"))
    feats = clustering.features(content)
    each = clustering.terms(feats)
    made = clustering.evidence(feats, each, spark.createDataFrame([(0, 3), (1, 2)], "a long, b long"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "array_intersect" not in plan
    assert rows(made, "a", "b", "n_distinctive", "n_identity", "n_phrases", "n_entities") == [(0, 3, 1, 1, 1, 2), (1, 2, 0, 0, 1, 2)]


def test_sets_that_share_one_rare_item_are_not_compared(spark, monkeypatch):
    one, two = ([f"{of}{k}" for k in range(1_999)] for of in "xy")
    whole = one + two  # makes the words of either set more frequent than the one they share
    sets = spark.createDataFrame([(1, [*one, "shared"]), (2, [*two, "shared"]), (3, whole), (4, whole), (5, whole[1:])], "item_id long, items array<string>")
    made = {}
    monkeypatch.setattr(dedup, "materialise", lambda df, what, *by: made.setdefault(what, materialise(df, what, *by)))
    assert rows(dedup.similar_pairs(sets), "a", "b") == [(3, 5)]
    assert rows(made["near"], "a", "b") == [(3, 5)]
    small = spark.createDataFrame([(1, ["p"]), (2, ["p", "q"]), (3, ["r"])], "item_id long, items array<string>")
    made.clear()
    assert rows(dedup.similar_pairs(small, 50), "a", "b") == [(1, 2)]
