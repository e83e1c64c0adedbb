"""Request filters, bases of urls, feeds, embed answers and exports, on rows that need each branch."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.operators import filters
from lodestream.plans import ingest
from lodestream.sources import exports, payloads


def test_request_filters(spark):
    rows = spark.createDataFrame(
        [(1, "pull_request", "image", "see http://a.b", None, ["Ab"]), (2, None, "text", None, None, None), (3, "post", None, "x", "https://c.d", ["cd", "ab"]), (4, "odd", "", "", "", [])],
        "id long, source_type string, media_type string, text string, link string, hashtags array<string>",
    )
    kept = lambda **k: [r.id for r in rows.filter(filters.request_filter(**k)).orderBy("id").collect()]
    assert kept() == [1, 2, 3, 4]
    assert kept(content_types=["issues", "record"]) == [1, 2] and kept(content_types=["odd"]) == [4]
    assert kept(media=True) == [1] and kept(media=False) == [2, 3, 4]
    assert kept(links=True) == [1, 3] and kept(links=False) == [2, 4]
    assert kept(hashtags=["AB"]) == [1, 3] and kept(hashtags=["zz"]) == [] and kept(hashtags=["ab"], media=False) == [3]
    assert rows.limit(0).filter(filters.request_filter(media=True)).count() == 0


def test_urls_under_a_base(spark):
    cases = [
        ("https://a.example/x/y", "https://a.example/x", True), ("https://a.example/xy", "https://a.example/x", False), ("https://a.example/x?q=1", "https://a.example/x/", True), ("HTTPS://a.example/", "https://a.example", True),
        ("http://a.example/x", "https://a.example/x", False), ("https://a.example:8443/x", "https://a.example/x", False), ("https://u@a.example/x", "https://a.example", False), (None, "https://a.example", False), ("no url", "https://a.example", False),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "url string, base string")
    assert [r[0] for r in rows.select(filters.under(F.col("url"), F.col("base"))).collect()] == [c[2] for c in cases]


def test_feeds(spark):
    rss = '<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><guid isPermaLink="false">g1</guid><link>https://a.example/1</link><title>One &amp; two</title><description><![CDATA[<p>body</p>]]></description><pubDate>Tue, 02 Jan 2024 03:04:05 +0200</pubDate></item><item><link>https://a.example/2</link><title>no body</title></item><item><title>no link</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><id>e1</id><link href="https://b.example/1" rel="alternate"/><title>Entry</title><content>text</content><author><name>N</name></author><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    feeds = spark.createDataFrame([(rss,), (atom,), ("<rss><channel>",), ("",), (None,), ("plain",)], "payload string")
    rows = {r.external_id: r for r in payloads.normalise(payloads.feed_payloads(feeds), "rss").withColumn("seconds", F.unix_seconds("published_at")).collect()}
    assert set(rows) == {"g1", "https://a.example/2", "e1"}
    assert (rows["g1"].title, rows["g1"].text, rows["g1"].seconds) == ("One & two", "body", 1704157445)
    assert (rows["https://a.example/2"].text, rows["https://a.example/2"].seconds) == ("no body", None)
    assert (rows["e1"].url, rows["e1"].author, rows["e1"].text, rows["e1"].seconds) == ("https://b.example/1", "N", "text", 1704153600)


def test_embed_answers(spark):
    answers = ['{"title": "t", "type": 3, "author_name": true, "provider_name": null, "provider_url": ["x"], "author_url": {"a": 1}, "html": "<b>"}', "[1]", "{broken", None, "{}"]
    rows = spark.createDataFrame([(a,) for a in answers], "p string").select(payloads.embed_metadata(F.col("p"))).collect()
    assert [r[0] for r in rows] == [{"title": "t", "type": "3", "author_name": "true"}, None, None, None, {}]


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([("=1+1", 'say "hi"\nthere', ["a", "b"], 5, "left out"), (None, "é", None, None, "x")], "title string, text string, hashtags array<string>, like_count long, other string")
    rows = exports.export_rows(items, "q")
    assert rows.columns == exports.EXPORT_COLUMNS and len(rows.columns) == 37
    exports.write_export(rows.coalesce(1), str(tmp_path / "e"))
    [part] = Path(tmp_path / "e").glob("part-*.csv")
    data = part.read_bytes().decode("utf-8")
    assert data.startswith("\ufeffquery,source,") and "'=1+1" in data and 'say ""hi""' in data and "a|b" in data
    head = exports.export_head({"query": "q"}, spark.createDataFrame([(2,)], "results long")).collect()
    assert [json.loads(r.value) for r in head] == [{"schema": "search-export", "version": "1.0", "search": {"query": "q"}, "analytics": {"results": 2}}]


@pytest.mark.parametrize("name", ["payload_normalise", "payload_stage_counts"])
def test_posts_of_blank_long_and_partial_documents(spark, tmp_path, name):
    long = "the and " + "word " * 4_200_000  # more than 20 million characters
    documents = [
        (600, "the and", "en", "src1"), (601, "", "en", "src1"), (602, "   ", "en", "src1"), (603, None, "en", "src1"), (604, "the and", None, "src1"), (605, "the and", "en", None),
        (606, long, "en", "src1"), (607, "", "en", "src3"), (None, "the and", "en", "src1"), (10**10 + 1, "\nthe and", "en", "src2"), (1, "the \x00 and", "en", "src1"),
    ]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    query, sql = ingest.QUERIES[name]
    made = query(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = db.execute(f"SELECT {', '.join(made.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(wanted, key=repr)
