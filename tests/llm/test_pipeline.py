"""The stages of the corpus pipeline, each against brute force on its own input."""

import hashlib
import random

import pytest

import corpus_pipeline
from lodestream.llm import bpe
from test_training_data import brute_components, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    rows, labels = [], []
    items = [prose(7000 + k, 25) for k in range(4)]
    for k in range(260):
        text = prose(4000 + k, 60)
        if k % 10 == 1:
            text = prose(4000 + k - 1, 60).replace("alpha", "alpha", 1) + " tail"
        if k % 17 == 0:
            text += " " + items[k % 4]
        if k % 4 == 0:
            w = text.split()
            w.insert(9, r.choice(["moron", "idiot"]))
            text = " ".join(w)
            labels.append((k, 1, 1))
        else:
            labels.append((k, 1, 0))
        rows.append((k, text + "\nThe common footer", "en", f"s{k % 15}", 0))
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_one_by_one(spark, corpus):
    d, rows, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [k for k in range(260) if k % 4]

    lines = stages["line dedup"](spark, clean, d)
    assert lines.columns == docs.columns
    own = {r.doc_id: r for r in lines.collect()}
    assert {k: r.text for k, r in own.items()} == {k: t.removesuffix("\nThe common footer") for k, t, *_ in rows if k % 4}
    assert all(r.n_chars == len(r.text) for r in own.values())

    kept = stages["MinHash near-dedup"](spark, lines, d)
    want = brute_components([(k, r.text) for k, r in own.items()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if c == k)

    safe = stages["benchmark decontamination"](spark, kept, d)
    bad = {r.doc_id for r in kept.collect() if any(i in r.text for i in items)}
    assert bad and sorted(r.doc_id for r in safe.collect()) == sorted(r.doc_id for r in kept.collect() if r.doc_id not in bad)

    codec = bpe.Codec(bpe.default_vocabulary())
    got = {r.doc_id: r.ids_sha256 for r in stages["BPE encoding and decoding"](spark, safe, d).collect()}
    assert got == {r.doc_id: hashlib.sha256(codec.encode_many([r.text])[0]).hexdigest() for r in safe.collect()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == got


def test_stages_take_an_empty_table(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_stages_handle_nulls_repeats_and_clashing_columns(spark, corpus):
    d, rows, items = corpus
    extra = [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, None, "en", "s1", 0), (None, "no id at all " + prose(9, 30), "en", "s2", 9), (902, prose(10, 40), "en", None, 5), (902, prose(10, 40), "en", None, 5), (903, "The common footer", "en", "s3", 17), (904, prose(77, 9000), "en", "s4", 1)]
    names = ["h1", "gone", "own", "id", "key", "digest", "item_id", "uid", "text_hash", "predicted", "component_id", "kept", "n_lines", "lines"]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{c}' as {c}" for c in names))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, d).collect(), docs.schema)
        assert kept.columns == docs.columns
        assert all(r[c] == c for r in kept.limit(3).collect() for c in names)
        ids = sorted(str(r.doc_id) for r in kept.collect())
        assert {"900", "901", "903", "904", "None"} <= set(ids) and ids.count("902") == 2 and ids.count("None") == 2, name
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[900] is None and texts[901] == "" and texts[903] == "" and texts[904] == prose(77, 9000)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, d).count() == kept.count()


def test_without_labels_no_document_is_toxic(spark, corpus, tmp_path):
    d, rows, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)


def test_rows_without_id_are_decided_one_by_one(spark, corpus):
    d, rows, items = corpus
    clean, toxic, leak = prose(9100, 50), prose(9101, 20) + " moron idiot moron idiot", prose(9102, 20) + " " + items[0]
    docs = spark.createDataFrame([(None, t, "en", "s", 1) for t in (clean, toxic, leak)] + [(k, *rest) for k, *rest in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    assert sorted(r.text for r in kept.filter("doc_id is null").collect()) == sorted([clean, leak])
    kept = corpus_pipeline.drop_contaminated(spark, kept, d)
    assert [r.text for r in kept.filter("doc_id is null").collect()] == [clean]
