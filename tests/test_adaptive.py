"""Calibration, routing, pools, fusion weights and the evidence graph against plain rules."""

import math
import random

from pyspark.sql import functions as F

from lodestream.operators import calibration, evidence, planning, pools

OBSERVED = "user long, round int, candidates int, sources int, completeness double, agreement double, disagreement double, margin double, unqueried int, single_engine boolean, degraded boolean, hard boolean, elapsed double, requests int, unique int, admitted int"


def test_risk_adds_points_and_takes_them_back(spark):
    calm = dict(user=1, round=1, candidates=12, sources=3, completeness=0.7, agreement=0.65, disagreement=10.0, margin=9.0, unqueried=1, single_engine=False, degraded=False, hard=False, elapsed=1.0, requests=1, unique=10, admitted=10)
    cases = [({}, 1), ({"candidates": 4, "sources": 1, "completeness": 0.4, "agreement": 0.3, "disagreement": 31.0, "margin": 2.0, "unqueried": 3}, 14), ({"candidates": 9, "sources": 2, "completeness": 0.6, "agreement": 0.5, "disagreement": 25.0, "margin": 7.0}, 7)]
    cases += [({"hard": True, "single_engine": True, "degraded": True}, 4), ({"hard": True, "unqueried": 0}, 0), ({"sources": 4, "candidates": 15, "agreement": 0.7, "margin": 1.0, "unqueried": 3}, 2), ({"unqueried": 0, "margin": 1.0}, 1)]
    rows = [tuple((calm | change | {"user": k})[c.split()[0]] for c in OBSERVED.split(", ")) for k, (change, _) in enumerate(cases)]
    got = calibration.with_previous(spark.createDataFrame(rows, OBSERVED), "user").withColumn("risk", calibration.risk()).select("user", "risk", calibration.level(F.col("risk")).alias("level")).collect()
    assert {r.user: r.risk for r in got} == {k: want for k, (_, want) in enumerate(cases)}
    assert {r.level for r in got} == {"LOW", "MEDIUM", "HIGH"}


def test_saturation_rules_in_order(spark):
    base = (1, 1, 12, 3, 0.7, 0.65, 10.0, 9.0, 1, False, False, False, 1.0, 1)
    rows = [(1, *base[1:], 100, 100), (1, 2, *base[2:], 5, 4), (1, 3, *base[2:], 4, 4), (2, *base[1:12], 50.0, 1, 1, 1), (3, *base[1:12], 1.0, 9, 1, 1), (4, 7, *base[2:], 1, 1), (5, *base[1:8], 0, *base[9:], 1, 1), (6, *base[1:], 0, 0), (6, 2, *base[2:], 0, 0)]
    found = calibration.with_previous(spark.createDataFrame(rows, OBSERVED), "user")
    got = {(r.user, r["round"]): r.d for r in found.select("user", "round", calibration.saturation(F.lit("LOW"), 40, 5, 5).alias("d")).collect()}
    assert got == {(1, 1): "SATISFIED", (1, 2): "LOW_MARGINAL_GAIN", (1, 3): "SATISFIED", (2, 1): "TIME_BUDGET", (3, 1): "REQUEST_BUDGET", (4, 7): "MAX_ROUNDS", (5, 1): "SOURCE_EXHAUSTION", (6, 1): "SATISFIED", (6, 2): "LOW_MARGINAL_GAIN"}
    unsure = found.filter("user = 6 and round = 1").select(calibration.saturation(F.lit("HIGH"), 40, 5, 5)).first()[0]
    assert unsure == "UNCERTAINTY_WITH_AVAILABLE_COVERAGE"


def test_stop_reasons_all_eight(spark):
    cases = [("HIGH", 1.0, 0, 1, 1, 99.0, 1, 2, False), ("HIGH", 1.0, 0, 1, 1, 1.0, 20, 2, False), ("HIGH", 1.0, 60, 1, 1, 1.0, 1, 2, False), ("LOW", 1.0, 12, 1, 1, 1.0, 1, 2, False), ("HIGH", 0.1, 3, 2, 1, 1.0, 1, 2, False), ("HIGH", 1.0, 3, 1, 1, 1.0, 1, 2, False), ("HIGH", 1.0, 3, 3, 1, 1.0, 1, 2, False), ("HIGH", 1.0, 3, 1, 0, 1.0, 1, 0, False), ("HIGH", 1.0, 3, 1, 0, 1.0, 1, 2, False), ("LOW", 1.0, 60, 1, 1, 1.0, 1, 2, True)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, level string, gain double, results int, round int, unqueried int, elapsed double, requests int, available int, more boolean")
    c = F.col
    got = [r.s for r in frame.orderBy("k").select(planning.stop_reason(c("level"), c("gain"), c("results"), 60, c("round"), 3, c("unqueried"), c("elapsed"), 12.0, c("requests"), 12, c("available"), c("more")).alias("s")).collect()]
    assert got == ["TIME_BUDGET", "REQUEST_BUDGET", "USER_LIMIT", "SATISFIED", "LOW_MARGINAL_GAIN", None, "MAX_ROUNDS", "NO_AVAILABLE_SOURCES", "SOURCE_EXHAUSTION", None]


def test_shadow_route_protects_the_first_four_and_the_capable(spark):
    rows = [(1, f"s{k}", 90.0 - 9 * k, 95.0 if k == 7 else 10.0, k != 2, (-3.0 if k >= 5 else None), (9 if k >= 5 else None)) for k in range(9)] + [(1, "s9", 10.0, 1.0, True, -3.0, 2)]
    got = {r.source: (r.place, r.shadow_place, r.recommendation, r.reason) for r in calibration.shadow_route(spark.createDataFrame(rows, "q long, source string, total double, capability double, available boolean, adjustment double, observations long"), "q").collect()}
    assert [got[f"s{k}"][3] for k in range(10)] == ["protected", "protected", "unavailable", "protected", "insufficient evidence", "low yield", "low yield", "protected", "low yield", "insufficient evidence"]
    assert got["s2"][2] == "DEFER" and got["s7"][2] == "SELECT" and all(v[0] == v[1] for v in got.values())


def test_pool_ranks_by_disagreement_and_keeps_the_quota(spark):
    of = lambda rows: spark.createDataFrame(rows, "query_id long, item_id long, rank int")
    lists = {"production": of([(1, 10, 1), (1, 11, 2), (2, 20, 1), (1, 99, 11)]), "fusion": of([(1, 11, 1), (1, 10, 9)]), "diversity": of([(1, 10, 3), (1, 12, 5)])}
    queries = spark.createDataFrame([(1, "news", "HIGH"), (2, "خبر", "MEDIUM")], "query_id long, query string, uncertainty string")
    got = {(r.query_id, r.item_id): r for r in pools.pool(lists, queries).collect()}
    assert {k: r.priority for k, r in got.items()} == {(1, 10): 8 + 8, (1, 11): 1 + 8, (1, 12): 10 + 8, (2, 20): 10 + 10 + 4}
    assert (got[1, 10].production_rank, got[1, 10].fusion_rank, got[1, 10].diversity_rank) == (1, 9, 3) and got[1, 12].production_rank is None
    assert sorted((r.query_id, r.item_id) for r in pools.pool(lists, queries, quota=1).collect()) == [(1, 12), (2, 20)]


def test_fusion_weights_equal_plain_ranking(spark):
    r = random.Random(3)
    queries = [(q, "ab"[q % 2], 6) for q in range(8)]
    rows = [(q, i, float(r.randrange(101)), float(r.randrange(101)), int(r.random() < 0.3)) for q, _, _ in queries for i in range(40)]
    got = {(x.query_class, x.weight): (x.ndcg, x.precision, x.chosen) for x in pools.fusion_weights(spark.createDataFrame(rows, "query_id long, item_id long, lexical double, semantic double, hit int"), spark.createDataFrame(queries, "query_id long, query_class string, n_relevant long")).collect()}
    want = {}
    for c in "ab":
        for w in pools.GRID:
            ndcg, p5 = [], []
            for q in (q for q, k, _ in queries if k == c):
                top = sorted((x for x in rows if x[0] == q), key=lambda x: (round(w * x[2] + (1 - w) * x[3], 6), x[2], x[1]), reverse=True)[:10]
                ideal = sum(1 / math.log2(k + 2) for k in range(6))
                ndcg.append(sum(x[4] / math.log2(k + 2) for k, x in enumerate(top)) / ideal)
                p5.append(sum(x[4] for x in top[:5]) / 5)
            want[c, w] = (sum(ndcg) / 4, sum(p5) / 4)
        used = want[c, 0.25]
        best = max(pools.GRID, key=lambda w: (*want[c, w], -abs(w - 0.25)))
        take = best if want[c, best][0] >= used[0] + 0.02 and want[c, best][1] >= used[1] else 0.25
        for w in pools.GRID:
            n, p, chosen = got[c, w]
            assert abs(n - want[c, w][0]) < 1e-6 and abs(p - want[c, w][1]) < 1e-6 and chosen == (w == take)


def test_graph_upsert_equals_folding_everything(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["Q", "q", "z"]), k // 2, f"https://e.org/{k % 9}", r.choice("ab"), r.choice([None, "", "@X", "@x"]), [f"T{k % 3}", "t0"] if k % 2 else None, r.choice([None, "s1"]), r.choice([None, k]), {"p": str(k), f"k{k % 4}": "v"}) for k in range(60)]
    frame = spark.createDataFrame(rows, "seq long, query string, content_id long, url string, source string, handle string, hashtags array<string>, story string, session long, properties map<string,string>")
    nodes, edges = evidence.observe(frame)
    shown = lambda df: sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in row) for row in df.collect()), key=repr)
    early, late = evidence.observe(frame.filter("seq < 25")), evidence.observe(frame.filter("seq >= 25"))
    assert shown(evidence.upsert_nodes(evidence.fold_nodes(early[0]), late[0]).select(*evidence.fold_nodes(nodes).columns)) == shown(evidence.fold_nodes(nodes))
    assert shown(evidence.upsert_edges(evidence.fold_edges(early[1]), late[1]).select(*evidence.fold_edges(edges).columns)) == shown(evidence.fold_edges(edges))
    own = {r.key: r for r in evidence.fold_nodes(nodes).filter("kind = 'content'").collect()}
    assert own["3"].properties == {"p": "7", "k2": "v", "k3": "v"} and (own["3"].first_seen, own["3"].last_seen) == (6, 7)
    support = evidence.fold_edges(edges).filter("relation = 'published_on'").agg(F.sum("support")).first()[0]
    assert support == 60
    labels = {r.key: r.label for r in evidence.fold_nodes(nodes).filter("kind = 'query'").collect()}
    assert labels["q"] == next(x[1] for x in rows if x[1].lower() == "q")
    assert evidence.fold_nodes(evidence.observe(frame.limit(0))[0]).count() == 0


def test_sums_of_doubles_do_not_depend_on_how_rows_are_dealt(spark):
    from lodestream.operators import ordering, planning

    values = [1e16, 1.0, -1e16, 1.0, 0.1, 0.2, 0.3]
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "g int, k int, v double")
    want = 0.0
    for v in values:
        want += v
    for dealt in (rows.coalesce(1), rows.orderBy(rows.k.desc()), rows.repartition(7, "k")):
        got = ordering.running_sums(dealt, ["g"], "k", {"s": dealt.v}).groupBy("g").agg(ordering.last("s", "k").alias("s")).first()
        assert got.s == want
    tenths = spark.createDataFrame([(0, k, "s", 0.6 if k % 2 else 0.5, "e", 1, 0.0, 0.0) for k in range(12)], "q int, k int, source string, completeness double, engine string, variant int, lexical double, semantic double")
    a, b = (planning.uncertainty(x, "q", "k").first().completeness for x in (tenths.repartition(5, "k"), tenths.coalesce(1)))
    total = 0.0
    for k in range(12):
        total += 0.6 if k % 2 else 0.5
    assert a == b == total / 12
