from pyspark.sql.window import Window

from lodestream.functions import numbers, text
from lodestream.operators import aggregates as A
from lodestream.operators import lattice
from lodestream.operators import retrieval as R
from lodestream.plans import memory, retrieval

ODD = ["", None, "Straße don't_x", "naïve Ærø – “Ŋœ” 12", "a\x1fb\x85c d", "٢٠٢٤ قِصَّة ​ﬁne", "été İstanbul ΣΑΣ", "#Tag ª² ½ x\x7fy", "日本語 テスト"]


def test_words_inside_of_tasks_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)], "k int, x string").select("k", text.tokens(retrieval.F.col("x")), text.index_tokens(retrieval.F.col("x"))).collect()
    for k, words, bare in rows:
        assert (words, bare) == text.words_of(ODD[k]), ODD[k]


def test_candidate_branches_cut_no_words_after_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "s", "en", "of the", "of the and in", "https://example.net", "@src3", None)], "item_id long, source string, language string, title string, text string, canonical_url string, handle string, hashtags array<string>")
    monkeypatch.setattr(retrieval, "content", lambda *_: docs)
    found = retrieval.candidate_match_branches(spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "PythonUDF" not in plan and "parquet" in plan
    assert tuple(found.first()) == (1, True, True, True, True, True)


def test_best_of_many_queries_make_no_row_for_a_pair(spark, monkeypatch):
    F = retrieval.F
    words = ["ab", "cd", "ef", "gh", "été"]
    # copies tie, one id stands in two rows, one item holds no term, one has no text
    docs = [(k % 57, " ".join(words[j] for j in range(5) if k >> j & 1), " ".join([words[k % 5]] * (k % 7) + ["zz"] * (k % 3)) or None, "@x") for k in range(58)] + [(90, "zz", "zz", "@x")]
    rows = spark.createDataFrame(docs, "item_id long, title string, text string, handle string")
    asked = spark.createDataFrame([("q1", "ab"), ("q1", "ete"), ("q2", "cd"), ("q2", "zz"), ("q2", "nowhere"), ("q3", "gh"), ("q4", "nowhere")], "query_id string, term string")
    monkeypatch.setattr(retrieval, "content", lambda *_: rows)
    monkeypatch.setattr(retrieval, "query_set", lambda *_: asked)
    w = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "item_id")
    scored = R.bm25(rows, asked).withColumn("bm25", numbers.rounded(F.col("bm25"), 6)).withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    want = sorted(map(tuple, scored.select("query_id", "item_id", "bm25", "rank").collect()))
    for cells in (4_000_000, 20):
        monkeypatch.setattr(R, "CELLS", cells)
        found = retrieval.bm25_multi_query_topk(spark, "")
        assert sorted(map(tuple, found.collect())) == want and len(want) == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#0, item_id" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    monkeypatch.setattr(R, "MOST_TERMS", 2)
    assert sorted(map(tuple, retrieval.bm25_multi_query_topk(spark, "").collect())) == want


def test_variants_meet_rows_without_a_row_for_each_pair(spark, monkeypatch):
    F = retrieval.F
    # query 1 by two of three words, 2 by its identifier, 3 by its only word; row 6 comes twice, each with one word of query 1
    rows = [(1, "Ab x CD"), (2, "ab ab"), (3, "see cve-2024-1 now"), (4, "2024 cve 1"), (5, None), (6, "ab"), (6, "ef"), (7, "STRASSE"), (8, "ab cd ef straße")]
    docs = spark.createDataFrame([(k, x, (x or "").lower()) for k, x in rows], "item_id long, words string, evidence string")
    made = [(1, "a", "ORIGINAL", "ab cd ef", 0.0), (1, "b", "NORMALIZED", "ab cd ef", 0.0), (1, "c", "EVIDENCE_EXPANDED", "x", 0.9), (2, "d", "ORIGINAL", "CVE-2024-1", 0.0), (2, "e", "IDENTIFIER", "CVE-2024-1", 0.0), (3, "f", "ORIGINAL", "Straße", 0.0)]
    v = spark.createDataFrame(made, "query_id int, variant_id string, kind string, text string, drift double")
    want = [(1, 1), (3, 2), (6, 1), (7, 3), (8, 1), (8, 3)]
    for cells in (4_000_000, 1):
        monkeypatch.setattr(lattice, "CELLS", cells)
        found = lattice.matches_any(docs, v)
        assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, lattice.matches_any(docs.withColumn("words", text.tokens(F.col("words"))), v).collect())) == want
    plan = lattice.matches_any(docs.filter("item_id <> 6"), v)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan.split("LeftAnti")[0]  # matches are made in front of any join or aggregate of words
    monkeypatch.setattr(lattice, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, lattice.matches_any(docs, v).collect())) == want


def test_orders_of_results_shuffle_no_text_and_join_once(spark, tmp_path):
    docs = [(k, f"t{k % 9}\n" + "ab" * (k % 5), "en", f"s{k % 4}") for k in range(40)] + [(40, None, "en", "s0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://a")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.sql("select id as event_id, timestamp_ntz'2024-01-30' + make_interval(0, 0, 0, 0, int(id % 7)) as ts, double(id % 6) as value, '{\"k\": 1}' as props from range(30)").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(3,), (3,), (5,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")  # one of them twice
    found = retrieval.sort_orders(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "text" not in plan
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "pages", "events", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.execute(f"SELECT mode, rank, item_id, \"cross\", final FROM ({retrieval.ORDERS_SQL})").fetchall()
    assert sorted(map(tuple, found.select("mode", "rank", "item_id", "cross", "final").collect())) == sorted(want) and len(want) == 60


def test_a_snapshots_words_are_cut_ahead_of_the_joins_and_counted_by_batches(spark, tmp_path):
    F = retrieval.F
    odd = [*ODD, "see HTTPS://a.b/c\u00a0d www.x y the The THE ab abc", "wwwx.y http:/no http://", "the\u2028and\x0bof www.\x1cqqq"]
    rows = spark.createDataFrame([(k, "Title one", x) for k, x in enumerate(odd)], "k int, title string, text string")
    before = F.filter(F.array_distinct(text.tokens(F.regexp_replace(F.concat_ws(" ", "title", "text"), A.URL, " "))), lambda w: (F.length(w) > 2) & ~w.isin(A.snapshot_skip(["one"])))
    for r in rows.select("k", before.alias("a"), A.topic_words(F.col("title"), F.col("text"), A.snapshot_skip(["one"])).alias("b")).collect():
        assert r.a == r.b.split(), odd[r.k]
    found = A.related_terms(rows, text.tokens(F.col("text")))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert (got := [tuple(r) for r in found.collect()])[0] == ("www", 2) and len(got) == 12 and got[1:] == sorted(got[1:])
    spark.createDataFrame([(1, "a\nb", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://a")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-30' as ts, 1d as value, '{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    plan = memory._items(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ArrowEvalPython")  # below the joins
