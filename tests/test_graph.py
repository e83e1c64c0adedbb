from lodestream.operators import graph


def test_stars_need_no_round_and_chains_are_one_component(spark, monkeypatch):
    made, materialise = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, what: made.append(what) or materialise(df, what))
    star = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(20, 21), (5, 5)], "a long, b long")
    assert dict(map(tuple, graph.components(star).collect())) == {k: 1 for k in range(1, 9)} | {20: 20, 21: 20}
    assert len(made) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(40, 31), (31, 50)], "a long, b long")
    assert dict(map(tuple, graph.components(chain).collect())) == {k: 1 for k in range(1, 13)} | {k: 31 for k in (31, 40, 50)}
    assert graph.components(star.filter("a > 99")).count() == 0
