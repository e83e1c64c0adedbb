"""Scalar functions against hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import numbers, text


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def ts(x):
    return F.lit(x).cast("timestamp")


def test_freshness_halves_every_two_days(spark):
    now = ts("2024-01-05 00:00:00")
    assert tuple(one(spark, *(numbers.freshness(ts(d), now) for d in ("2024-01-05 00:00:00", "2024-01-03 00:00:00", "2024-01-01 00:00:00", "2024-02-01 00:00:00", None)))) == (100.0, 50.0, 25.0, 100.0, 25.0)


def test_scores(spark):
    lit = F.lit
    assert one(spark, numbers.cross_source(lit(1)), numbers.cross_source(lit(2)), numbers.cross_source(lit(3)), numbers.cross_source(lit(9)))[:] == (0.0, 40.0, 60.0, 100.0)
    scales = numbers.PLATFORM_SCALES["mock"]
    e = numbers.engagement({"likes": lit(30), "shares": lit(None).cast("int")}, scales)
    assert one(spark, e, numbers.engagement({"views": lit(3)}, scales), numbers.engagement({"likes": lit(-5)}, scales))[:] == (100.0, 0.0, 0.0)
    assert one(spark, numbers.social_reach(lit("rss"), lit(50.0), lit(1)), numbers.social_reach(lit("x"), lit(50.0), lit(1)))[:] == (None, 40.0)
    assert one(spark, numbers.rounded(lit(0.125), 2), numbers.rounded(lit(2.5), 0))[:] == (0.12, 2.0)
    assert one(spark, numbers.token_rarity(lit(0.0), lit(0.0)), numbers.token_rarity(lit(99.0), lit(99.0)))[:] == (0.5, 0.0)
    shares = [one(spark, numbers.split_evenly(lit(11), lit(3), lit(k)))[0] for k in (1, 2, 3)]
    assert shares == [4, 4, 3]
    assert one(spark, numbers.temporal_proximity(ts(None), ts("2024-01-01")), numbers.temporal_proximity(ts("2024-01-01"), ts("2024-01-15")))[:] == (0.5, 0.5)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://News.Example.NET/a/B/?z=9&utm_campaign=q&k=1#top", "http://news.example.net/a/B?k=1&z=9"),
        ("http://example.com:80//a///b/", "http://example.com/a/b"),
        ("https://user:pw@example.com:8443/x", "https://example.com:8443/x"),
        ("example.com/p?ref=1&gclid=2", "https://example.com/p"),
        ("https://example.com:port/x", "https://example.com/x"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonical_url(F.lit(url)))[0] == want


def test_tokens_and_languages(spark):
    row = one(spark, text.tokens(F.lit("  Straße, foo_bar​ ÜBER ٣٤! ")), text.language(F.lit("12 !")), text.language(F.lit("كتاب abc")), text.language(F.lit("hello")), text.language_label(F.lit("EN-us"), F.lit("x")), text.language_label(F.lit("und"), F.lit("كتاب")))
    assert row[0] == ["strasse", "foo_bar", "über", "34"] and row[1:] == ("und", "ar", "en", "en", "ar")
    assert one(spark, text.normalise(F.lit("أإآ ىؤئة ـ")))[0] == "ااا يويه"
    words = ["Straße", "ﬁne  Ｗide", "كتابٌ", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.normalise_exact("w")).collect()
    assert [r[0] for r in got] == ["strasse", "fine wide", "كتاب", ""]


def test_phrases_proximity_and_bigrams(spark):
    words = F.split(F.lit("a b c d a x b"), " ")
    run = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert one(spark, text.contains_run(words, run("b", "c")), text.contains_run(words, run("b", "d")), text.contains_run(words, run()))[:] == (True, False, False)
    assert one(spark, text.proximity(words, ["a", "b"]), text.proximity(words, ["d", "x"]), text.proximity(words, ["a", "z"]), text.proximity(words, []))[:] == (1.0, pytest.approx(2 / 3), 0.0, 0.0)
    assert one(spark, text.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), text.bigrams(F.array(F.lit("a"))))[:] == (["a b", "b c"], [])


def test_marks_html_and_cells(spark):
    t = F.lit("see #One and#two #one @a.b mail@x #One")
    row = one(spark, text.hashtags(t), text.mentions(t), text.hashtags(F.lit("none")), text.strip_tags(F.lit("<p>a&amp;b<br/>c</p>")), text.spreadsheet_safe(F.lit(" =1")), text.spreadsheet_safe(F.lit("a=1")))
    assert row[0] == ["One", "one"] and row[1] == ["a.b"] and row[2] is None and row[3:] == ("a&b c", "' =1", "a=1")
    html = spark.createDataFrame([("<div>a&eacute;<p>b</p>\n c</div>",), (None,)], "h string").select(text.html_to_text("h")).collect()
    assert [r[0] for r in html] == ["aé b c", None]


def test_spam_and_snippet(spark):
    row = one(spark, text.spam_penalty(F.lit("T"), F.lit("short"), F.lit("u")), text.spam_penalty(F.lit(None), F.lit("WOW!!!!! BUY NOW OR NEVER, ALL THE THINGS YOU NEED"), F.lit("x?utm_a=1&utm_b=2")))
    assert row[:] == (5.0, 13.0)
    long = "x " * 200 + "needle " + "y " * 400
    cut, tiny, both, none, plain = one(spark, *(text.snippet(F.lit(x).cast("string"), terms) for x, terms in ((long, ["needle"]), ("tiny", ["zz"]), ("aaa Ab+C ab+cd 𝒳 AB", ["ab+c", "aa", "b", "(", r"\E"]), (None, ["a"]), ("  a \n b ", []))))
    assert cut.snippet.startswith("...") and cut.snippet.endswith("...") and [cut.snippet[r.start : r.end] for r in cut.ranges] == ["needle"]
    assert (tiny.snippet, tiny.ranges) == ("tiny", []) and (none.snippet, none.ranges) == (None, None) and (plain.snippet, plain.ranges) == ("a b", [])
    assert [tuple(r) for r in both.ranges] == [(0, 2), (4, 8), (9, 13), (18, 19)]


def test_snippets_scan_a_text_once(spark):
    rows = spark.createDataFrame([(1, "a\u2028\x1cb\u00a0 İx ıX\u3000"), (2, None), (3, ""), (4, "𝒳 " * 300 + "THE\ttion thetion")], "k int, x string").select("k", text.snippet(F.col("x"), ["ix", "the", "tion"]).alias("s"))
    got = {r.k: (r.s.snippet, r.s.ranges and [r.s.snippet[a:b] for a, b in r.s.ranges]) for r in rows.collect()}
    assert got[1] == ("a b İx ıX", ["İx", "ıX"]) and got[2] == (None, None) and got[3] == ("", [])
    assert len(got[4][0]) == 363 and got[4][0].startswith("...𝒳") and got[4][1] == ["THE", "tion", "thetion"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "rlike" not in plan.lower()  # the expressions of before took the text apart once for each use


@pytest.mark.parametrize("q, want", [("#a", "HASHTAG"), ("@a", "HANDLE"), ("https://x.y", "URL"), ('"a b"', "EXACT_PHRASE"), ("كتاب book", "MIXED_LANGUAGE"), ("ai", "SHORT_AMBIGUOUS"), ("CVE-2024-12345", "RARE_ENTITY"), ("Acme", "SHORT_AMBIGUOUS"), ("Acme Corp", "RARE_ENTITY"), ("one two three", "MULTI_TERM_TOPIC")])
def test_query_classes(spark, q, want):
    assert one(spark, text.query_class(F.lit(q)))[0] == want


def test_identifiers(spark):
    flags = one(spark, *(text.has_identifier(F.lit("see CVE-2024-12345 in 2024 at a.example.com"), k) for k in ("cve", "ghsa", "year", "domain", "quoted")))
    assert flags[:] == (True, False, True, True, False)


def test_rounding_equals_pythons_on_exact_values(spark):
    r = random.Random(7)
    xs = [2.675, 0.125, 0.375, -0.125, 1.005, 0.5, 1.5, 2.5, -2.5, 0.0, 1e15 + 0.3, 4503599627370495.5, 1e300, 5126801.5021179635, 0.285, 1.115, 5e-7]
    for _ in range(100_000):
        xs.append(r.choice([r.uniform(-100, 100), r.randrange(-(10**6), 10**6) / 1000 + 0.0005 * r.randrange(3), (r.randrange(10**7) * 2 + 1) / 2 ** r.randrange(1, 12), r.expovariate(1) * 10 ** r.randrange(-6, 9)]))
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    digits = (0, 1, 2, 4, 6, 9)
    for x, row in zip(xs, frame.select("x", *(numbers.rounded(F.col("x"), d).alias(f"d{d}") for d in digits)).collect()):
        assert row.x == x and list(row)[1:] == [round(x, d) for d in digits], x
    odd = spark.sql("select explode(array(cast(null as double), double('NaN'), double('Infinity'))) as x").select(numbers.rounded(F.col("x"), 2)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and odd[2][0] == float("inf")
