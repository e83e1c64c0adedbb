"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions import numbers, text
from lodestream.operators import filters
from lodestream.operators import retrieval as R
from lodestream.sources.scratch import materialise
from lodestream.sources.tables import CONTENT_SQL, ENGAGEMENT_SQL, FRESHNESS_SQL, NOW_SQL, SPAM_SQL, content, documents, engagement, index_tokens_sql, norm_sql, now, rounded_sql, table, tokens_sql

QUERY = R.Query(("the", "and", "in"))
PHRASE = R.Query(("of", "the"), exact=True)


def rank_lexical_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank(content(spark, sf_dir), QUERY, now(), engagement())


def _in(words, column: str) -> str:
    return " + ".join(f"list_contains({column}, '{w}')::INT" for w in words)


TOKENISED_SQL = f"""WITH {CONTENT_SQL}, tok AS (
  SELECT *, list_concat(title_words, text_words, {tokens_sql('handle')}, {tokens_sql("array_to_string(hashtags, ' ')")}) AS words, 2 * (len(title_index) + len(text_index) + len(author_index)) AS dl
  FROM (SELECT *, {tokens_sql('title')} AS title_words, {tokens_sql('text')} AS text_words, {index_tokens_sql('title')} AS title_index, {index_tokens_sql('text')} AS text_index, {index_tokens_sql('handle')} AS author_index FROM content)
), stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM tok
), each AS (
  SELECT item_id, dl, unnest(title_index) AS term, 8.0 AS weight FROM tok UNION ALL SELECT item_id, dl, unnest(text_index), 2.0 FROM tok UNION ALL SELECT item_id, dl, unnest(author_index), 1.0 FROM tok
), posted AS (SELECT item_id, term, sum(weight) AS tf, any_value(dl) AS dl FROM each GROUP BY 1, 2
), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1)"""
BM25_PART = "greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_W = QUERY.distinct
_SEEN = ", ".join(f"max(pos) FILTER (WHERE term = '{w}') OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p{i}" for i, w in enumerate(_W))
_MATCHED = f"list_filter({list(_W)}, lambda w: list_contains(words, w))"
_FEATURES = f"""{TOKENISED_SQL}, score0 AS (
  SELECT item_id, sum({BM25_PART}) AS bm25 FROM posted JOIN df USING (term), stats WHERE term IN {_W} GROUP BY 1
), cand AS (
  SELECT tok.*, coalesce(bm25, 0) AS bm25 FROM tok LEFT JOIN score0 USING (item_id) WHERE {_in(_W, 'words')} >= {QUERY.required}
), positions AS (SELECT item_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM cand
), seen AS (SELECT item_id, term, pos, {_SEEN} FROM positions
), near AS (
  SELECT item_id, least(1.0, {len(_W)}.0 / min(pos - least({', '.join(f'p{i}' for i in range(len(_W)))}) + 1)) AS proximity FROM seen
  WHERE term IN {_W} AND {' AND '.join(f'p{i} IS NOT NULL' for i in range(len(_W)))} GROUP BY 1
), feat AS (
  SELECT cand.*, {rounded_sql('coalesce(100 * bm25 / nullif(max(bm25) OVER (), 0), 0)', 2)} AS bm25_normalised,
    ({_in(_W, 'words')}) / {float(len(_W))} AS coverage, ({_in(_W, 'title_words')}) / {float(len(_W))} AS title_coverage, ({_in(_W, 'text_words')}) / {float(len(_W))} AS body_coverage,
    {', '.join(f"contains(' ' || array_to_string({c}, ' ') || ' ', ' {' '.join(_W)} ')::INT AS {n}" for c, n in (('words', 'phrase'), ('title_words', 'title_phrase'), ('text_words', 'body_phrase')))}, coalesce(proximity, 0) AS proximity
  FROM cand LEFT JOIN near USING (item_id)
), rel AS (
  SELECT *, {rounded_sql('least(100.0, 35 * coverage + 15 * title_coverage + 15 * phrase + 15 * title_phrase + 10 * proximity + bm25_normalised / 10)', 2)} AS relevance,
    {FRESHNESS_SQL} AS freshness, {ENGAGEMENT_SQL} AS engagement, {SPAM_SQL} AS spam FROM feat
)"""


def _score_sql(cross: str, novelty: str) -> dict[str, str]:
    weighed = {k: rounded_sql(f"{w} * {x}", 4) for k, w, x in (("relevance", 0.35, "relevance"), ("freshness", 0.2, "freshness"), ("engagement", 0.15, "engagement"), ("source_confidence", 0.1, "70.0"), ("cross_source", 0.1, cross), ("novelty", 0.1, novelty))}
    factor = rounded_sql("pow(relevance / 100, 2.0)", 4)
    before = f"{weighed['relevance']} + {factor} * ({' + '.join(v for k, v in weighed.items() if k != 'relevance')})"
    return {"score": rounded_sql(f"greatest(0.0, least(100.0, {before} - spam))", 2), "pre_penalty": rounded_sql(f"greatest(0.0, least(100.0, {before}))", 2), "factor": factor} | {f"w_{k}": v for k, v in weighed.items()}


RANK_SQL = f"""{_FEATURES}, scored AS (SELECT *, {_score_sql('0.0', '100.0')['score']} AS score FROM rel)
SELECT item_id, source, bm25_normalised, relevance, {rounded_sql('100 * proximity', 2)} AS proximity, freshness, engagement, spam, score
FROM scored ORDER BY score DESC, relevance DESC, published_at DESC NULLS LAST, item_id DESC LIMIT 20"""


def rank_explained_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking with copies told apart: cross-source weight, novelty, and how each score came about."""
    ranked = R.rank(content(spark, sf_dir), QUERY, now(), engagement(), copies=text.content_fingerprint(F.col("title"), F.col("text")))
    return ranked.withColumn("matched_terms", F.array_join("matched_terms", ","))


_OWN = _score_sql("cross_source", "novelty")
EXPLAINED_SQL = f"""{_FEATURES}, keyed AS (SELECT *, regexp_replace({norm_sql("title || ' ' || text")}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS fp FROM rel
), grp AS (SELECT fp, count(*) AS n, count(DISTINCT source) AS sources, arg_max(item_id, {{'p': coalesce(epoch_us(published_at), -4611686018427387904), 's': source, 'i': item_id}}) AS canonical FROM keyed GROUP BY fp HAVING count(*) > 1
), sig AS (SELECT keyed.*, CASE WHEN n IS NULL OR sources <= 1 THEN 0.0 ELSE least(100.0, 40.0 + 20.0 * (sources - 2)) END AS cross_source, CASE WHEN n IS NULL OR item_id = canonical THEN 100.0 ELSE 40.0 END AS novelty FROM keyed LEFT JOIN grp USING (fp)
), scored AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _OWN.items())} FROM sig)
SELECT item_id, source, score, relevance, cross_source, novelty, spam, {', '.join(k for k in _OWN if k != 'score')}, array_to_string({_MATCHED}, ',') AS matched_terms
FROM scored ORDER BY score DESC, relevance DESC, published_at DESC NULLS LAST, item_id DESC LIMIT 20"""


def relevance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence(content(spark, sf_dir), QUERY, []).withColumn("matched_terms", F.array_join("matched_terms", ","))


FEATURES_SQL = f"""{_FEATURES}
SELECT item_id, bm25_normalised, relevance, {', '.join(rounded_sql('100 * ' + c, 2) + ' AS ' + c for c in ('coverage', 'title_coverage', 'body_coverage', 'proximity'))},
  100.0 * phrase AS phrase, 100.0 * title_phrase AS title_phrase, 100.0 * body_phrase AS body_phrase, 0.0 AS intent_exact, array_to_string({_MATCHED}, ',') AS matched_terms FROM rel"""


def phrase_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact query is one term of the index: adjacent words within a column."""
    found = R.bm25_of(materialise(R.index(content(spark, sf_dir), list(PHRASE.distinct)), "index"), PHRASE)
    return found.select("item_id", numbers.rounded(F.col("bm25"), 6).alias("bm25"))


def _phrases_sql(column: str) -> str:
    a, b = PHRASE.words
    return f"len(list_filter(range(1, len({column})), lambda i: {column}[i] = '{a}' AND {column}[i + 1] = '{b}'))"


PHRASE_SQL = f"""{TOKENISED_SQL}, ph AS (SELECT item_id, dl, 8.0 * {_phrases_sql('title_index')} + 2.0 * {_phrases_sql('text_index')} + 1.0 * {_phrases_sql('author_index')} AS tf FROM tok
), hit AS (SELECT *, (SELECT count(*) FROM ph WHERE tf > 0) AS df FROM ph WHERE tf > 0)
SELECT item_id, {rounded_sql(BM25_PART, 6)} AS bm25 FROM hit, stats"""


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term: the distinct words of each benchmark text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))


def bm25_multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_top(content(spark, sf_dir), query_set(spark, sf_dir), 10)


MULTI_SQL = f"""{TOKENISED_SQL}, qs AS (SELECT DISTINCT item_id AS query_id, strip_accents(unnest({tokens_sql('text')})) AS term FROM benchmark
), scored AS (
  SELECT query_id, item_id, {rounded_sql(f'sum({BM25_PART})', 6)} AS bm25 FROM posted JOIN df USING (term) JOIN qs USING (term), stats GROUP BY 1, 2
)
SELECT query_id, item_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, item_id) AS rank FROM scored QUALIFY rank <= 10"""

_BRANCHES = {"phrase": PHRASE, "enough_words": QUERY, "url": R.Query(("example", "net"), intent="url", normalised="example.net"), "handle": R.Query(("src3",), intent="handle")}


def candidate_match_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each item fares as a candidate of a phrase, of words, of a url and of a handle query, and whether it holds all words."""
    words = [w for q in _BRANCHES.values() for w in q.distinct]
    # written once: each of the matches reads the places several times, and would cut the words again
    rows = materialise(R.index(content(spark, sf_dir), words, ["handle", "hashtags", "canonical_url"]), "index")
    every = F.size(F.array_except(F.array(*map(F.lit, QUERY.distinct)), F.transform("hits", lambda h: h["term"]))) == 0
    return rows.select("item_id", *(R.matches(q).alias(k) for k, q in _BRANCHES.items()), every.alias("all_words"))


MATCH_SQL = f"""{TOKENISED_SQL}
SELECT item_id, contains(' ' || array_to_string(words, ' ') || ' ', ' of the ') AS phrase, {_in(_W, 'words')} >= {QUERY.required} AS enough_words,
  contains({norm_sql('canonical_url')}, 'example.net') AS url, handle = '@src3' AS handle, {_in(_W, 'words')} = {len(_W)} AS all_words FROM tok"""

#: A tag query over all documents; each carries its language and its source as tags.
TAG = R.Query(("de",), intent="hashtag")


def match_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tag query takes as candidates, by the documents' tags and by what stands behind a # in their texts, with its features."""
    rows = content(spark, sf_dir).withColumns({"hashtags": F.array(F.concat(F.lit("#"), F.upper("language")), F.col("source")), "text": F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("#De "), "text")).otherwise(F.col("text"))})
    rows = rows.withColumn("literal_tags", R.literal_tags(F.col("title"), F.col("text")))
    f = R.relevance(TAG, F.lit(0.0))
    indexed = materialise(R.index(rows, list(TAG.distinct), ["handle", "hashtags", "canonical_url", "literal_tags"]), "index")
    return indexed.filter(R.matches(TAG)).select("item_id", f["relevance"].alias("relevance"), f["intent_exact"].alias("intent_exact"), f["title_coverage"].alias("title_coverage"))


MATCH_FIXTURE_SQL = f"""WITH {CONTENT_SQL}, t AS (SELECT item_id, language, title, CASE WHEN item_id % 7 = 0 THEN '#De ' || text ELSE text END AS text, source, handle FROM content
), w AS (SELECT item_id, language = 'de' AS tagged, list_contains({tokens_sql('title')}, 'de') AS title, list_contains(list_concat({tokens_sql('title')}, {tokens_sql('text')}, {tokens_sql('handle')}, {tokens_sql("language || ' ' || source")}), 'de') AS found, regexp_matches(lower(title || ' ' || text), '(^|\s)#de(\s|$)') AS literal FROM t)
SELECT item_id, {rounded_sql('least(100.0, 60.0 * found::INT + 30.0 * title::INT + 10.0 * tagged::INT)', 2)} AS relevance, 100.0 * tagged::INT AS intent_exact, 100.0 * title::INT AS title_coverage FROM w WHERE tagged OR literal"""

_PLAIN_LETTERS, _WIDE_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９"


def normalise_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in full width, with marks that do not show, Arabic digits and a ligature, and what normalising makes of them."""
    rows = documents(spark, sf_dir).select("item_id", F.concat(F.translate("title", _PLAIN_LETTERS, _WIDE_LETTERS), F.lit("\u200b ﬁne ٢٠٢٤ قِصَّة")).alias("x"))
    return rows.select("item_id", text.normalise(F.col("x")).alias("normal"), F.size(text.tokens(F.col("x"))).cast("long").alias("n_words"), F.element_at(text.index_tokens(F.col("x")), -1).alias("last"))


NORMALISE_FIXTURE_SQL = f"""WITH t AS (SELECT doc_id AS item_id, split_part(text, chr(10), 1) || ' fine 2024 قصه' AS x FROM documents)
SELECT item_id, {norm_sql('x')} AS normal, len({tokens_sql('x')})::BIGINT AS n_words, 'قصه' AS last FROM t"""

#: A query of each kind from a document's language and source (fixed forms), with its intent, exactness and class.
_FORMS = [("#{}Data", "hashtag", False, "HASHTAG"), ("@{}", "handle", False, "HANDLE"), ("https://example.org/{}", "url", False, "URL"), ('"{} policy"', "exact_phrase", True, "EXACT_PHRASE"), ("{} تقنية", "mixed_language", False, "MIXED_LANGUAGE"), ("how to bake {}", "keywords", False, "MULTI_TERM_TOPIC")]


def query_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, class and words of queries of every kind, made of each document's language."""
    form = F.element_at(F.array(*(F.lit(f) for f, *_ in _FORMS)), (F.col("item_id") % len(_FORMS) + 1).cast("int"))
    rows = documents(spark, sf_dir).select("item_id", F.replace(form, F.lit("{}"), F.col("language")).alias("q"))
    p = text.query_intent(F.col("q"))
    return rows.select("item_id", p["intent"].alias("intent"), p["exact"].alias("exact"), p["class"].alias("class"), F.array_join(p["tokens"], "|").alias("words"))


_FORM_WORDS = ["{}data", "{}", "https|example|org|{}", "{}|policy", "{}|تقنيه", "how|to|bake|{}"]
QUERY_FIXTURE_SQL = "WITH f(k, intent, exact, class, words) AS (VALUES " + ", ".join(f"({k}, '{i}', {str(e).lower()}, '{c}', '{w}')" for k, ((_, i, e, c), w) in enumerate(zip(_FORMS, _FORM_WORDS))) + f") SELECT doc_id AS item_id, intent, exact, class, replace(words, '{{}}', lang) AS words FROM documents JOIN f ON k = doc_id % {len(_FORMS)}"



def filter_time_language_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, publication window (missing dates pass) and link filters."""
    rows = content(spark, sf_dir)
    since = now() - F.expr("INTERVAL 30 DAYS")
    kept = rows.filter(F.col("language").isin("en", "de") & (F.col("published_at").isNull() | (F.col("published_at") >= since)))
    return kept.filter(~F.col("text").rlike("https?://")).select("item_id", "language", "published_at")


FILTER_SQL = f"""WITH {CONTENT_SQL}
SELECT item_id, language, published_at FROM content WHERE language IN ('en', 'de') AND (published_at IS NULL OR published_at >= {NOW_SQL} - INTERVAL 30 DAY)
  AND NOT regexp_matches(text, 'https?://')"""


def text_normalise_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("words", text.tokens(F.col("text")))
    return rows.select("item_id", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), text.language(F.col("text")).alias("detected"), F.md5(text.normalise(F.col("text"))).alias("digest"), F.get("words", F.lit(0)).alias("first_word"))


TOKENS_SQL = f"""SELECT doc_id AS item_id, len(ws)::BIGINT AS n_words, len(list_distinct(ws))::BIGINT AS n_distinct,
  CASE WHEN regexp_matches(text, '\\p{{L}}') THEN 'en' ELSE 'und' END AS detected, md5(norm) AS digest, ws[1] AS first_word
FROM (SELECT doc_id, text, {norm_sql('text')} AS norm, {tokens_sql('text')} AS ws FROM documents)"""


def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 under each of the four orders, each a TakeOrdered of the ranked rows."""
    rows = content(spark, sf_dir).select("item_id", "source", "published_at", engagement().alias("engagement"), numbers.freshness(F.col("published_at"), now()).alias("score"))
    newest, best, busy, last = F.col("published_at").desc_nulls_last(), F.col("score").desc(), F.col("engagement").desc(), F.col("item_id").desc()
    orders = {"best_match": [best, newest, last], "newest": [newest, best, last], "most_engaged": [busy, best, newest, last], "by_source": [F.col("source"), best, newest, last]}
    tops = [rows.orderBy(*o).limit(15).select(F.lit(mode).alias("mode"), "item_id", "engagement", "score") for mode, o in orders.items()]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _order_sql(mode: str, order: str) -> str:
    return f"(SELECT '{mode}' AS mode, item_id, engagement, score FROM r ORDER BY {order} LIMIT 15)"


SORT_SQL = f"""WITH {CONTENT_SQL}, r AS (SELECT item_id, source, published_at, {ENGAGEMENT_SQL} AS engagement, {FRESHNESS_SQL} AS score FROM content)
""" + " UNION ALL ".join(
    [
        _order_sql("best_match", "score DESC, published_at DESC NULLS LAST, item_id DESC"),
        _order_sql("newest", "published_at DESC NULLS LAST, score DESC, item_id DESC"),
        _order_sql("most_engaged", "engagement DESC, score DESC, published_at DESC NULLS LAST, item_id DESC"),
        _order_sql("by_source", "source, score DESC, published_at DESC NULLS LAST, item_id DESC"),
    ]
)


def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen under each order of results, with their ranks; ties end at source and id.

    A copy stands behind its group's representative, and what has a vector
    before what has none; presence across sources counts those with the same text.
    """
    facts = lambda d: d.filter("text is not null").select("item_id", "source", F.unhex(F.md5("text")).alias("digest"), F.length("title").alias("lexical"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit(1).alias("semantic")).distinct()
    rows = content(spark, sf_dir, facts).join(vectors, "item_id", "left")
    rows = rows.select("item_id", "source", "published_at", "digest", engagement().alias("engagement"), numbers.freshness(F.col("published_at"), now()).alias("final"), "lexical", F.coalesce("semantic", F.lit(0)).alias("semantic"))
    rows = materialise(rows, "results")
    # texts that stand once need no group
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("canonical"), numbers.cross_source(F.countDistinct("source")).alias("shared")).filter("n > 1").drop("n")
    rows = rows.join(groups, "digest", "left").drop("digest")
    rows = rows.withColumns({"representative": F.coalesce(F.col("item_id") == F.col("canonical"), F.lit(True)).cast("int"), "cross": F.coalesce("shared", F.lit(0.0)), "stable": F.concat_ws(":", "source", F.col("item_id").cast("string"))})
    rows = materialise(rows.drop("canonical", "shared", "source"), "ordered")  # read once for each order
    at, last = F.col("published_at").desc_nulls_last(), F.col("stable").desc()
    down = lambda *names: [F.col(c).desc() for c in names]
    orders = {"best_match": [*down("representative", "semantic", "final", "lexical"), at, last], "newest": [at, *down("final"), last], "most_engaged": [*down("engagement", "final"), at, last], "cross_platform": [*down("cross", "final"), at, last]}
    out = None
    for mode, order in orders.items():
        top = rows.orderBy(*order).limit(15)
        one = top.select(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "item_id", "cross", "final")  # of fifteen rows
        out = one if out is None else out.unionByName(one)
    return out


_ORDERS = {"best_match": "representative DESC, semantic DESC, final DESC, lexical DESC", "newest": "", "most_engaged": "engagement DESC, final DESC", "cross_platform": "x DESC, final DESC"}
ORDERS_SQL = f"""WITH {CONTENT_SQL}, r AS (SELECT item_id, source, published_at, {ENGAGEMENT_SQL} AS engagement, {FRESHNESS_SQL} AS final, length(title) AS lexical, source || ':' || item_id AS stable, item_id = min(item_id) OVER (PARTITION BY md5(text)) AS representative, md5(text) AS digest, item_id IN (SELECT vec_id FROM embeddings) AS semantic FROM content
), g AS (SELECT digest, count(DISTINCT source) AS k FROM r GROUP BY 1), j AS (SELECT r.*, CASE WHEN k <= 1 THEN 0.0 ELSE least(100.0, 40.0 + 20.0 * (k - 2)) END AS x FROM r JOIN g USING (digest))
""" + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, row_number() OVER (ORDER BY {(order + ', ') if order else ''}published_at DESC NULLS LAST, {'final DESC, ' if mode == 'newest' else ''}stable DESC)::INT AS rank, item_id, x AS \"cross\", final FROM j QUALIFY rank <= 15" for mode, order in _ORDERS.items()
)


def fair_round_robin_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir).select("item_id", "source", numbers.freshness(F.col("published_at"), now()).alias("score"), F.md5("text").alias("digest"))
    return R.fair_admission(rows, "source", [F.col("score").desc(), F.col("item_id")], ["digest"], 50, 120).select("item_id", "source", "source_rank", "score")


ADMIT_SQL = f"""WITH {CONTENT_SQL}, r AS (SELECT item_id, source, {FRESHNESS_SQL} AS score, md5(text) AS digest FROM content
), own AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY digest ORDER BY score DESC, item_id) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) AS source_rank FROM own)
SELECT item_id, source, source_rank, score FROM ranked WHERE source_rank <= 50 ORDER BY source_rank, source LIMIT 120"""


def snippet_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets around two terms and where these stand in them."""
    rows = documents(spark, sf_dir).filter(F.lower("text").contains("tion"))
    rows = rows.select("item_id", text.snippet(F.col("text"), ["tion", "the"]).alias("made"))
    spans = F.transform("made.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return rows.select("item_id", "made.snippet", F.array_join(spans, ",").alias("ranges"))


SNIPPET_SQL = """WITH f AS (
  SELECT doc_id AS item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents WHERE contains(lower(text), 'tion')
), p AS (SELECT *, least(nullif(instr(lower(flat), 'tion'), 0), coalesce(nullif(instr(lower(flat), 'the'), 0), 1000000000)) AS found FROM f
), b AS (SELECT *, greatest(0, least(greatest(0, coalesce(found, 1) - 91), length(flat) - 360)) AS b FROM p
), s AS (SELECT item_id, substr(flat, b + 1, 360) AS body, CASE WHEN b > 0 THEN '...' ELSE '' END AS before, CASE WHEN b + 360 < length(flat) THEN '...' ELSE '' END AS after FROM b
), pos AS (SELECT item_id, body, before, unnest(range(1, length(body) + 1)) AS i FROM s
), h AS (SELECT item_id, length(before) + i - 1 AS s, length(before) + i - 1 + length(term) AS e FROM pos, (VALUES ('tion'), ('the')) w(term) WHERE lower(substr(body, i, length(term))) = term
), m AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS first FROM h
), g AS (SELECT *, sum(first::INT) OVER (PARTITION BY item_id ORDER BY s, e) AS k FROM m
), r AS (SELECT item_id, k, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2
), a AS (SELECT item_id, string_agg(s || '-' || e, ',' ORDER BY s) AS ranges FROM r GROUP BY 1)
SELECT item_id, before || body || after AS snippet, coalesce(ranges, '') AS ranges FROM s LEFT JOIN a USING (item_id)"""


def request_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items each of several requests wants by type, media, links and tags; an item's types follow from its id."""
    at = lambda values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("item_id") % len(values) + 1).cast("int"))
    rows = documents(spark, sf_dir).select("item_id", "text", at(_SOURCE_TYPES).alias("source_type"), at(_MEDIA).alias("media_type"), F.when(F.col("item_id") % 11 == 0, "https://example.org").alias("link"), F.array(F.initcap("source"), "language").alias("hashtags"))
    marks = F.array(*(F.when(filters.request_filter(**r), F.lit(name)) for name, r in _REQUESTS.items()))
    return rows.select("item_id", F.explode(F.array_compact(marks)).alias("request"))


_SOURCE_TYPES = ["post", "video", "pull_request", "article", None, "dataset", "issue"]
_MEDIA = ["image", "text", None, "", "video"]
_REQUESTS = {"types": {"content_types": ["issues", "news", "record"]}, "media": {"media": True}, "no_media": {"media": False, "content_types": ["posts", "dataset"]}, "links": {"links": True}, "tags": {"hashtags": ["SRC1", "De"], "links": False}}
REQUEST_SQL = """WITH d AS (
  SELECT doc_id AS item_id, (['post', 'video', 'pull_request', 'article', 'record', 'dataset', 'issue'])[doc_id % 7 + 1] AS kind, doc_id % 5 IN (0, 4) AS media, doc_id % 11 = 0 OR regexp_matches(text, 'https?://') AS links, lower(source) AS source, lower(lang) AS lang FROM documents)
SELECT item_id, 'types' AS request FROM d WHERE kind IN ('pull_request', 'issue', 'article', 'record') UNION ALL SELECT item_id, 'media' FROM d WHERE media
UNION ALL SELECT item_id, 'no_media' FROM d WHERE NOT media AND kind IN ('post', 'dataset') UNION ALL SELECT item_id, 'links' FROM d WHERE links
UNION ALL SELECT item_id, 'tags' FROM d WHERE NOT links AND (source = 'src1' OR lang = 'de' OR lang = 'src1' OR source = 'de')"""


def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page lies under a base on its host: a language's path, a part of a path's segment, or the host itself."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.when(F.col("page_id") % 3 == 0, "/en/").when(F.col("page_id") % 3 == 1, "/e").otherwise("")
    return p.select("page_id", filters.under(F.col("url"), F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), path)).alias("allowed"))


ALLOWED_SQL = r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_matches(url, '^[a-z]+://[^/]+/en(/|[?#]|$)') WHEN 1 THEN regexp_matches(url, '^[a-z]+://[^/]+/e(/|[?#]|$)') ELSE true END AS allowed FROM pages"""


def intent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, class and identifier flags of the query set, whole texts."""
    b = table(spark, sf_dir, "benchmark")
    flags = [text.has_identifier(F.col("text"), k).alias(k) for k in ("cve", "year", "hashtag", "domain")]
    p = text.query_intent(F.col("text"))
    return b.select("item_id", p["intent"].alias("intent"), p["class"].alias("query_class"), F.size(p["tokens"]).alias("n_words"), *flags)


INTENT_SQL = r"""SELECT item_id, intent, CASE intent WHEN 'hashtag' THEN 'HASHTAG' WHEN 'handle' THEN 'HANDLE' WHEN 'url' THEN 'URL' WHEN 'exact_phrase' THEN 'EXACT_PHRASE' ELSE CASE WHEN len(ws) = 1 THEN 'SHORT_AMBIGUOUS' WHEN intent = 'organization_phrase' THEN 'RARE_ENTITY' ELSE 'MULTI_TERM_TOPIC' END END AS query_class, len(ws)::INT AS n_words,
  regexp_matches(text, '(?i)\bCVE-[0-9]{4}-[0-9]{4,}\b') AS cve, regexp_matches(text, '\b(19|20)[0-9]{2}\b') AS year, regexp_matches(text, '(^| )#[\p{L}\p{N}_]+') AS hashtag,
  regexp_matches(text, '\b[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|org|net|io|dev)\b') AS domain
FROM (SELECT item_id, text, ws, CASE WHEN starts_with(trim(text), '#') AND len(ws) > 0 THEN 'hashtag' WHEN starts_with(trim(text), '@') AND len(ws) > 0 THEN 'handle' WHEN regexp_matches(trim(text), '(?i)^https?://|^[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}(?:/|$)') THEN 'url'
  WHEN regexp_matches(trim(text), '^".*"$') THEN 'exact_phrase' WHEN len(ws) BETWEEN 2 AND 5 AND regexp_matches(text, '\p{Lu}') THEN 'organization_phrase' ELSE 'keywords' END AS intent
  FROM (SELECT item_id, text, list_distinct(""" + tokens_sql("text") + """) AS ws FROM benchmark))"""

QUERIES = {
    "rank_lexical_top20": (rank_lexical_top20, RANK_SQL),
    "rank_explained_top20": (rank_explained_top20, EXPLAINED_SQL),
    "phrase_bm25": (phrase_bm25, PHRASE_SQL),
    "match_fixture": (match_fixture, MATCH_FIXTURE_SQL),
    "normalise_fixture": (normalise_fixture, NORMALISE_FIXTURE_SQL),
    "query_fixture": (query_fixture, QUERY_FIXTURE_SQL),
    "relevance_features": (relevance_features, FEATURES_SQL),
    "bm25_multi_query_topk": (bm25_multi_query_topk, MULTI_SQL),
    "candidate_match_branches": (candidate_match_branches, MATCH_SQL),
    "filter_time_language_media": (filter_time_language_media, FILTER_SQL),
    "text_normalise_tokens": (text_normalise_tokens, TOKENS_SQL),
    "sort_orders": (sort_orders, ORDERS_SQL),
    "sort_modes": (sort_modes, SORT_SQL),
    "fair_round_robin_admission": (fair_round_robin_admission, ADMIT_SQL),
    "snippet_highlight": (snippet_highlight, SNIPPET_SQL),
    "request_filters": (request_filters, REQUEST_SQL),
    "allowed_hosts": (allowed_hosts, ALLOWED_SQL),
    "intent_labels": (intent_labels, INTENT_SQL),
}
