"""Cases with fixed answers: other scripts and widths, tags, handles, links, queries of every kind, outcomes, lattices."""

from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import coverage, lattice
from lodestream.operators import retrieval as R

#: A small corpus in other scripts and widths, with tags, handles and links.
POSTS = [
    (1, "#Ｐython release", "Read the #ﬁne notes at https://example.org/a", "@Core", ["Python"], "https://example.org/Python/"),
    (2, "قِصَّة جديدة", "نص عن #تقنية والأمن ٢٠٢٤", "@أخبار", ["تقنية"], "https://example.org/ar"),
    (3, "Straße und Café", "Die STRASSE am Caf\u00e9 ist zu", "@DE", None, "https://example.org/de?utm_source=x"),
    (4, None, "no title here #Python", "@core_team", [], "https://example.net/x"),
]
_POST_SCHEMA = "item_id long, title string, text string, handle string, hashtags array<string>, canonical_url string"
_POST_QUERIES = {
    "hashtag": R.Query(("python",), intent="hashtag"), "handle": R.Query(("core",), intent="handle"), "url": R.Query(("example", "net"), intent="url", normalised="example.net/x"),
    "phrase": R.Query(("strasse", "am"), exact=True), "words": R.Query(("strasse", "café", "die", "ist")), "arabic": R.Query(("تقنيه", "2024")),
}
#: kind, item, relevance, exactness of the intent
MATCHED = [('hashtag', 1, 100.0, 100.0), ('hashtag', 4, 60.0, 0.0), ('handle', 1, 70.0, 100.0), ('url', 4, 10.0, 100.0), ('phrase', 3, 67.5, 0.0), ('words', 3, 50.5, 0.0), ('arabic', 2, 41.67, 0.0)]


def test_posts_as_candidates_of_each_kind_of_query(spark):
    rows = spark.createDataFrame(POSTS, _POST_SCHEMA)
    rows = rows.withColumn("literal_tags", R.literal_tags(F.col("title"), F.col("text")))
    words = sorted({w for q in _POST_QUERIES.values() for w in q.distinct})
    indexed = R.index(rows, words, ["handle", "hashtags", "canonical_url", "literal_tags"]).cache()
    got = []
    for kind, q in _POST_QUERIES.items():
        f = R.relevance(q, F.lit(0.0))
        got += [(kind, *r) for r in indexed.filter(R.matches(q)).select("item_id", f["relevance"], f["intent_exact"]).collect()]
    indexed.unpersist()
    assert sorted(got) == sorted(MATCHED)


#: text, normal form, words, words of the index, language
_NORMAL = [
    ("Ｆｕｌｌ　Ｗｉｄｔｈ ①②", "full width 12", "full|width|12", "full|width|12", "en"),
    ("ﬁne ﬂow ½ x²", "fine flow 1⁄2 x2", "fine|flow|1|2|x2", "fine|flow|1|2|x2", "en"),
    ("STRASSE Straße ẞ", "strasse strasse ss", "strasse|strasse|ss", "strasse|strasse|ss", "en"),
    ("Ὀδυσσεύς ΟΔΟΣ", "ὀδυσσεύσ οδοσ", "ὀδυσσεύσ|οδοσ", "ὀδυσσεύσ|οδοσ", "en"),
    ("قِصَّةٌ إلى أحمد ٢٠٢٤ ۱۲", "قصه الي احمد 2024 12", "قصه|الي|احمد|2024|12", "قصه|الي|احمد|2024|12", "ar"),
    ("e\u0301te\u0301 Été", "été été", "été|été", "ete|ete", "en"),
    ("zero\u200bwidth \u202eturn\u202c", "zerowidth turn", "zerowidth|turn", "zerowidth|turn", "en"),
    ("  12 !! \t", "12 !!", "12", "12", "und"),
]


def test_normal_forms(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(_NORMAL)], "id long, x string")
    got = rows.select("id", text.normalise(F.col("x")), F.array_join(text.tokens(F.col("x")), "|"), F.array_join(text.index_tokens(F.col("x")), "|"), text.language(F.col("x"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: tuple(row[1:]) for k, row in enumerate(_NORMAL)}


#: query, intent, exact, class, words, variant without Arabic articles
_QUERIES = [
    ("#OpenData", "hashtag", False, "HASHTAG", "opendata", "opendata"),
    ("@someone", "handle", False, "HANDLE", "someone", "someone"),
    ("https://example.org/a", "url", False, "URL", "https|example|org|a", "https example org a"),
    ("example.org/path", "url", False, "URL", "example|org|path", "example org path"),
    ('"climate policy"', "exact_phrase", True, "EXACT_PHRASE", "climate|policy", "climate policy"),
    ("OpenAI تقنية", "mixed_language", False, "MIXED_LANGUAGE", "openai|تقنيه", "openai تقنيه"),
    ("rust", "keywords", False, "SHORT_AMBIGUOUS", "rust", "rust"),
    ("World Health Organization", "organization_phrase", False, "RARE_ENTITY", "world|health|organization", "world health organization"),
    ("how to bake bread", "keywords", False, "MULTI_TERM_TOPIC", "how|to|bake|bread", "how to bake bread"),
    ("الاقتصاد الرقمي", "keywords", False, "MULTI_TERM_TOPIC", "الاقتصاد|الرقمي", "اقتصاد رقمي"),
]


def test_intents_of_queries(spark):
    rows = spark.createDataFrame([(k, q[0]) for k, q in enumerate(_QUERIES)], "id long, q string")
    p = text.query_intent(F.col("q"))
    got = rows.select("id", p["intent"], p["exact"], p["class"], F.array_join(p["tokens"], "|"), text.article_variant(p["tokens"])).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: q[1:] for k, q in enumerate(_QUERIES)}


#: searches (id, results, planned, time range) with their runs (source, error, items, matches, time-eligible), and reason, cause, failed
_OUTCOMES = [
    (1, 3, 2, "all", [("rss", None, 3, 3, 3)], "RESULTS_AVAILABLE", None, 0), (2, 0, 0, "all", [], "NO_CAPABLE_SOURCE", None, 0), (3, 0, 1, "24h", [("rss", None, 0, 4, 1)], "NO_MATCHES_IN_TIME_RANGE", None, 0),
    (4, 0, 2, "all", [("x", "unconfigured", 0, 0, 0), ("reddit", "configuration_missing", 0, 0, 0)], "WEB_DISCOVERY_BLOCKED", None, 2), (5, 0, 2, "all", [("gdelt", "timeout", 0, 0, 0), ("x", "http_403", 0, 0, 0)], "ALL_SELECTED_SOURCES_FAILED", "EXTERNAL_LIMIT", 2),
    (6, 0, 2, "all", [("gdelt", "odd", 0, 0, 0), ("x", "http_403", 0, 0, 0)], "ALL_SELECTED_SOURCES_FAILED", "SOURCE_UNAVAILABLE", 2), (7, 0, 2, "7d", [("rss", None, 0, 2, 2), ("x", "timeout", 0, 0, 0)], "NO_MATCHES", None, 1),
]


def test_outcomes_of_searches(spark):
    searches = spark.createDataFrame([o[:4] for o in _OUTCOMES], "search long, results int, planned int, time_range string")
    runs = spark.createDataFrame([(o[0], *r) for o in _OUTCOMES for r in o[4]], "search long, source string, error string, items int, query_matches int, time_eligible int")
    assert sorted(map(tuple, coverage.outcome(searches, runs, "search").collect())) == [(o[0], *o[5:]) for o in _OUTCOMES]


#: query_id, original, flags, and the variants
_LATTICES = [
    (1, "Open   Data", False, False, True, False, False, False, False, False, ["ORIGINAL:Open Data", "NORMALIZED:open data", 'EXACT:"Open   Data"', "ENTITY_ALIAS:public data", "EVIDENCE_EXPANDED:Open Data portal"]),
    (2, "محمد علي", False, True, False, True, False, False, False, False, ["ORIGINAL:محمد علي", "NORMALIZED:محمد علي", 'EXACT:"محمد علي"', "ARABIC_NORMALIZED:محمد علي", "TRANSLITERATION:Mohammed Ali"]),
    (3, "@someone", False, False, False, False, False, True, False, False, ["ORIGINAL:@someone", "NORMALIZED:@someone", "HANDLE:@someone"]),
    (4, "#Tag", False, False, False, False, False, False, True, False, ["ORIGINAL:#Tag", "NORMALIZED:#tag", "HASHTAG:#Tag"]),
    (5, "CVE-2024-1234", False, False, False, False, False, False, False, True, ["ORIGINAL:CVE-2024-1234", "NORMALIZED:cve-2024-1234", "IDENTIFIER:CVE-2024-1234"]),
]


def lattices(spark):
    q = spark.createDataFrame([r[:10] for r in _LATTICES], "query_id long, original string, exact boolean, person boolean, entity boolean, arabic boolean, mixed boolean, handle boolean, hashtag boolean, identifier boolean")
    aliases = spark.createDataFrame([(1, "public data", 0.9), (1, "weak", 0.5), (5, "log4shell", 0.95)], "query_id long, text string, confidence double")
    more = spark.createDataFrame([(1, 1, "Open  Data portal", 0.8, 0.3), (1, 2, "drifting", 0.9, 0.5), (5, 1, "never", 0.9, 0.1)], "query_id long, n int, text string, confidence double, drift double")
    return lattice.build(q, aliases, more)


def test_variants_of_queries_and_their_rounds(spark):
    rows = lattices(spark)
    got = {}
    for r in rows.orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(" ".join(f"{r.kind}:{r.text}".split()))
    assert got == {r[0]: [" ".join(v.split()) for v in r[10]] for r in _LATTICES}
    second = sorted(map(tuple, lattice.secondary(rows, 2).select("query_id", "kind").collect()))
    assert second == [(1, "ENTITY_ALIAS"), (1, "EXACT"), (2, "EXACT"), (2, "TRANSLITERATION")]
    assert [tuple(r) for r in lattice.secondary(rows, 3).select("query_id", "kind").collect()] == [(1, "EVIDENCE_EXPANDED")]


def test_a_lattice_and_its_rounds_deal_each_query_once(spark):
    both = lattice.later(lattices(spark)).select("asked", "query_id", "kind")
    assert sorted(map(tuple, both.collect())) == [(2, 1, "ENTITY_ALIAS"), (2, 1, "EXACT"), (2, 2, "EXACT"), (2, 2, "TRANSLITERATION"), (3, 1, "EVIDENCE_EXPANDED")]
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    kept = {(r.query_id, r.kind): r for r in lattices(spark).collect()}
    assert kept[2, "TRANSLITERATION"].parent_id == kept[2, "NORMALIZED"].variant_id and kept[1, "ENTITY_ALIAS"].parent_id == kept[1, "ORIGINAL"].variant_id and kept[1, "ORIGINAL"].parent_id is None


#: query, time range, identifier, what it wants of time
_TEMPORAL = [
    ("history of rome", "all", False, "HISTORICAL"), ("history of rome", "24h", False, "TIME_CRITICAL"), ("breaking storm", "all", False, "TIME_CRITICAL"), ("recent storms", "all", False, "RECENT_PREFERRED"), ("storms 1998", "all", False, "HISTORICAL"),
    ("CVE-2024-1234 2024", "all", True, "TIME_NEUTRAL"), ("storms", "7d", False, "RECENT_PREFERRED"), ("storms", "30d", False, "RECENT_PREFERRED"), ("storms", "all", False, "TIME_NEUTRAL"), ("عاجل", "all", False, "TIME_CRITICAL"),
]


def test_what_queries_want_of_time(spark):
    rows = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(_TEMPORAL)], "id long, q string, time_range string, identifier boolean")
    got = rows.select("id", lattice.temporal_intent(text.tokens(F.col("q")), F.col("q"), F.col("time_range"), F.col("identifier")).alias("intent")).collect()
    assert {r.id: r.intent for r in got} == {k: r[3] for k, r in enumerate(_TEMPORAL)}
