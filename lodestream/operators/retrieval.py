"""Full-text retrieval: an index of a query's words, BM25 over weighted columns, lexical relevance and final scores.

The corpus is read and cut into words once.  What leaves the scan for each
item is its lengths and the places of the query's words, a small table that
is written; scores, document frequencies, phrases and the covering window all
come from it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestream.functions import numbers, text
from lodestream.functions.numbers import rounded
from lodestream.operators import tiles
from lodestream.sources.scratch import materialise

#: Weights of the final score (fixed values).
WEIGHTS = {"relevance": 0.35, "freshness": 0.20, "engagement": 0.15, "source_confidence": 0.10, "cross_source": 0.10, "novelty": 0.10}
K1, B = 1.2, 0.75
#: Column weights (fixed values); each column is indexed plain and normalised, so weights and lengths count twice.
COLUMN_WEIGHTS = {"title": 4.0, "text": 1.0, "author": 0.5}
#: Distinct words of a query set that are looked up in the scan; more are joined.
MOST_TERMS = 20_000
BROADCAST_ROWS = 500_000  # a query and a term
CELLS = 4_000_000  # of a matrix of items by terms or by queries


@dataclass(frozen=True)
class Query:
    """A parsed query: its words in order, whether they must stand together, its intent and its normalised text."""

    words: tuple[str, ...]
    exact: bool = False
    intent: str = "keywords"
    normalised: str = ""
    distinct: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "distinct", tuple(dict.fromkeys(self.words)))

    def array(self) -> Column:
        return F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")

    @property
    def required(self) -> int:
        n = len(self.distinct)
        return n if n <= 2 else -(-6 * n // 10)


def tokenised(content: DataFrame) -> DataFrame:
    """content with title_words, text_words and words: all of title, text, handle and hashtags (where there are such)."""
    rows = _with_author(content).withColumn("title_words", text.tokens(F.col("title"))).withColumn("text_words", text.tokens(F.col("text")))
    others = F.concat(text.tokens(F.col("handle")), text.tokens(F.array_join("hashtags", " ")))
    return rows.withColumn("words", F.concat("title_words", "text_words", others))


def _with_author(content: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in (("handle", "string"), ("hashtags", "array<string>"), ("canonical_url", "string")) if c not in content.columns}
    return content.withColumns(missing) if missing else content


def index(content: DataFrame, words: list[str], keep: list[str] | None = None) -> DataFrame:
    """item_id, n_title, n_text, dl, hits, marks and the columns `keep` of every item, from one pass over its text.

    hits: the places of the words in title, text, handle and hashtags, one
    after the other.  marks: their places as a full-text index sees them,
    without diacritics, column by column (title, text, author) with a gap
    between columns; dl is the length there, both copies of a column counted.
    """
    rows, keep = _with_author(content), keep or []
    if plain := [(f"{c}_index", of) for c, of in (("title", "title"), ("text", "text"), ("author", "handle")) if f"{c}_index" in keep]:
        rows = rows.withColumns({c: text.index_tokens(F.col(of)) for c, of in plain})
    looked_up = F.arrow_udf(_looked_up(list(words), sorted({m for w in words for m in _index_words(w)})), INDEXED, F.ArrowUDFType.SCALAR)
    found = rows.withColumn("__found", looked_up("title", "text", "handle", F.array_join("hashtags", " ")))
    return found.select("item_id", "__found.*", *keep)


INDEXED = "struct<n_title:int,n_text:int,dl:int,hits:array<struct<term:string,pos:int>>,marks:array<struct<term:string,pos:int,weight:double>>>"


def _looked_up(words: list[str], marked: list[str]):
    """Cuts columns of title, text, handle and joined hashtags into words, and gives INDEXED of each row."""
    hit, mark = frozenset(words), frozenset(marked)
    weights = [2 * w for w in COLUMN_WEIGHTS.values()]

    def run(title: pa.Array, body: pa.Array, handle: pa.Array, tags: pa.Array) -> pa.Array:
        sizes, hits, marks = [], [], []
        hit_ends, mark_ends = [0], [0]
        for row in zip(*(c.to_pylist() for c in (title, body, handle, tags))):
            own = [text.words_of(x) for x in row]
            at = 0
            for column, _ in own:
                if not hit.isdisjoint(column):
                    hits += [(w, at + i) for i, w in enumerate(column) if w in hit]
                at += len(column)
            at = size = 0
            for (_, bare), weight in zip(own, weights):
                if not mark.isdisjoint(bare):
                    marks += [(w, at + i, weight) for i, w in enumerate(bare) if w in mark]
                at += len(bare) + 1
                size += len(bare)
            sizes.append((len(own[0][0]), len(own[1][0]), 2 * size))
            hit_ends.append(len(hits))
            mark_ends.append(len(marks))

        def lists(ends: list[int], rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
            columns = zip(*rows) if rows else [[] for _ in kinds]
            values = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        place = {"term": pa.string(), "pos": pa.int32()}
        counts = [pa.array(c, pa.int32()) for c in (zip(*sizes) if sizes else ([], [], []))]
        return pa.StructArray.from_arrays([*counts, lists(hit_ends, hits, place), lists(mark_ends, marks, place | {"weight": pa.float64()})], ["n_title", "n_text", "dl", "hits", "marks"])

    return run


def _index_words(word: str) -> list[str]:
    """A query's word as the index holds it (driver side)."""
    return ["".join(text.BASE.get(c, c) for c in word)]


def candidates(rows: DataFrame, query: Query) -> DataFrame:
    """Rows of tokenised content that match: the phrase, or enough distinct words."""
    if not query.words:
        return rows.filter(F.lit(False))
    if query.exact:
        return rows.filter(text.contains_run(F.col("words"), query.array()))
    return rows.filter(F.size(F.array_intersect("words", F.array(*map(F.lit, query.distinct)))) >= query.required)


def matches(query: Query) -> Column:
    """Whether an indexed row is a candidate.

    Exact: the phrase.  url: the query within the url.  handle: the query's
    first word is the handle.  hashtag: it is a tag, or stands behind a # in
    title or text.  Else: enough distinct words.
    """
    if query.exact:
        return text.runs_among(F.col("hits"), list(query.words)) > 0
    if query.intent == "url":
        return F.lit(bool(query.normalised)) & F.contains(text.normalise(F.col("canonical_url")), F.lit(query.normalised))
    if not query.words:
        return F.lit(False)
    if query.intent == "handle":
        return text.normalise(F.regexp_replace("handle", "^@", "")) == query.words[0]
    if query.intent == "hashtag":
        return F.array_contains(_tags(F.col("hashtags")), query.words[0]) | F.col("literal_tags").isNotNull() & F.array_contains("literal_tags", query.words[0])
    return F.size(_found(query)) >= query.required


def literal_tags(title: Column, body: Column) -> Column:
    """What stands behind a # at the start of a word of title or text, folded."""
    return F.array_distinct(F.regexp_extract_all(text.folded(F.concat_ws(" ", title, body)), F.lit(r"(?<!\S)#(\S*)"), F.lit(1)))


def _tags(tags: Column) -> Column:
    return text.normalise_all(F.transform(tags, lambda t: F.regexp_replace(t, "^#", "")))


def _terms(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda h: h["term"]))


def _found(query: Query) -> Column:
    return F.array_intersect(F.array(*map(F.lit, query.distinct)), _terms(F.col("hits")))


def frequencies(indexed: DataFrame) -> DataFrame:
    """item_id, term, tf (weighted by column), dl of an index."""
    each = indexed.select("item_id", "dl", F.explode("marks").alias("m")).select("item_id", "dl", "m.term", "m.weight")
    return each.groupBy("item_id", "term").agg(F.sum("weight").alias("tf"), F.first("dl").alias("dl"))


def collection(indexed: DataFrame) -> DataFrame:
    """One row: n documents, average length."""
    return indexed.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)))


def _part(idf: Column) -> Column:
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(content: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item_id, bm25 for every query (query_id, term) and item that holds one of its terms.

    Query terms are compared without diacritics.  Up to MOST_TERMS distinct
    terms are looked up in the scan itself; a larger query set is joined.
    """
    q = queries.select("query_id", text.without_marks(F.col("term")).alias("term")).distinct()
    q = materialise(q, "query-terms")
    terms = [r.term for r in q.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = len(terms) <= MOST_TERMS
    indexed = index(content, terms if few else [], ["title_index", "text_index", "author_index"] if not few else None).select("item_id", "dl", "marks", *(() if few else ("title_index", "text_index", "author_index")))
    indexed = materialise(indexed, "index")
    if few:
        posted = frequencies(indexed)
    else:
        one = lambda c, w: indexed.select("item_id", "dl", F.explode(f"{c}_index").alias("term")).groupBy("item_id", "dl", "term").agg((F.count(F.lit(1)) * 2 * w).alias("tf"))
        each = None
        for c, w in COLUMN_WEIGHTS.items():
            each = one(c, w) if each is None else each.unionByName(one(c, w))
        posted = each.join(q.select("term").distinct(), "term", "left_semi").groupBy("item_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    posted = materialise(posted, "postings")
    df = document_frequency(posted).join(F.broadcast(collection(indexed)))  # one row
    weighed = q.join(df, "term").select("query_id", "term", idf(F.col("df")).alias("idf"), "avgdl")
    if q.count() <= BROADCAST_ROWS:
        weighed = F.broadcast(weighed)
    return posted.join(weighed, "term").groupBy("query_id", "item_id").agg(F.sum(_part(F.col("idf"))).alias("bm25"))


def bm25_top(content: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, item_id, bm25, rank: the k best items of every query (query_id, term), by rounded score, equal ones by id.

    Scores are those of `bm25`, summed in the order of terms.  Tasks score
    blocks of items for all queries as matrices and hand on the heads of the
    lists, so no row stands for a pair of query and item.  A query set beyond
    MOST_TERMS or BROADCAST_ROWS goes through `bm25`.
    """
    q = materialise(queries.select("query_id", text.without_marks(F.col("term")).alias("term")).distinct(), "query-terms")
    pairs = q.limit(BROADCAST_ROWS + 1).collect()
    place = {w: i for i, w in enumerate(sorted({r.term for r in pairs if r.term is not None}))}
    if len(pairs) > BROADCAST_ROWS or len(place) > MOST_TERMS:
        scored = bm25(content, q).withColumn("bm25", rounded(F.col("bm25"), digits))
    else:
        posted, stats = postings(content, place)
        df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        found = df.join(F.broadcast(stats)).select("term", idf(F.col("df")).alias("idf"), "avgdl").collect()  # a row for each term
        own: dict = {}
        for r in pairs:
            if r.term is not None:
                own.setdefault(r.query_id, []).append(place[r.term])
        weights = np.zeros(len(place))
        weights[[r.term for r in found]] = [r.idf for r in found]
        kind = q.schema["query_id"].dataType
        run = _heads(pa.array(list(own), to_arrow_type(kind)), [np.array(sorted(ts)) for ts in own.values()], weights, found[0].avgdl if found else 1.0, k, digits)
        scored = posted.mapInArrow(run, f"query_id {kind.simpleString()}, item_id {posted.schema['item_id'].dataType.simpleString()}, bm25 double")
    w = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), F.col("item_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "item_id", "bm25", "rank")


def postings(content: DataFrame, place: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """item_id, dl, terms (places), tfs of every item, and one row of n_docs and avgdl; rows of one id are one item."""
    looked_up = F.arrow_udf(_posted(place), "struct<dl:int,terms:array<int>,tfs:array<double>>", F.ArrowUDFType.SCALAR)
    rows = _with_author(content).withColumn("__found", looked_up("title", "text", "handle")).select("item_id", "__found.*")
    rows = materialise(rows, "postings")
    again = materialise(rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("item_id").alias("again")), "repeated")
    same = F.col("item_id").eqNullSafe(F.col("again"))
    each = rows.join(again, same, "left_semi").select("item_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    each = each.groupBy("item_id", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("tf"), F.first("dl").alias("dl"))
    merged = each.groupBy("item_id").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("p")).select("item_id", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
    return rows.join(again, same, "left_anti").unionByName(merged), collection(rows)


def _posted(place: dict[str, int]):
    """Cuts title, text and handle into words as the index holds them, and gives length, places of terms and weighted frequencies of each row."""
    weights = [2 * w for w in COLUMN_WEIGHTS.values()]

    def run(title: pa.Array, body: pa.Array, handle: pa.Array) -> pa.Array:
        sizes, ends, terms, tfs = [], [0], [], []
        for row in zip(*(c.to_pylist() for c in (title, body, handle))):
            size, found = 0, {}
            for x, weight in zip(row, weights):
                bare = text.words_of(x)[1]
                size += len(bare)
                for w, n in Counter(bare).items():
                    if (t := place.get(w)) is not None:
                        found[t] = found.get(t, 0.0) + n * weight
            sizes.append(2 * size)
            terms += found
            tfs += found.values()
            ends.append(len(terms))
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.float64()))]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), *lists], ["dl", "terms", "tfs"])

    return run


def _heads(ids: pa.Array, own: list[np.ndarray], weights: np.ndarray, avgdl: float, k: int, digits: int):
    """The k best of a task's items for each query: query_id, item_id, bm25."""
    n_queries, size = len(own), max(1, CELLS // max(1, len(weights), len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n_waiting = None, [], 0
        least = np.full(n_queries, -np.inf)  # steps of the last that is kept

        def best() -> pa.Table:
            every = pa.concat_tables([*([kept] if kept is not None else []), *waiting])
            every = every.sort_by([("query", "ascending"), ("steps", "descending"), ("item_id", "ascending")])
            query = every["query"].to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            full = np.flatnonzero(place == k - 1)
            least[query[full]] = every["steps"].to_numpy()[full]
            return every.take(pa.array(np.flatnonzero(place < k))).combine_chunks()

        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                items = batch.slice(begin, size)
                scores = _scores(items, own, weights, avgdl)
                n, open_ = items.num_rows, np.flatnonzero(np.isinf(least))
                bound = (least - 1) / 10**digits  # below, rounding cannot lift a score to the last
                if n > k and open_.size:
                    bound[open_] = np.partition(scores[open_], n - k, axis=1)[:, n - k] - 1.5 / 10**digits
                query, at = np.nonzero((scores >= bound[:, None]) & (scores > 0))
                waiting.append(pa.table({"query": query, "steps": tiles.steps(scores[query, at], digits), "item_id": items["item_id"].take(pa.array(at))}))
                n_waiting += len(at)
                if n_waiting > 2 * k * n_queries or open_.size:
                    kept, waiting, n_waiting = best(), [], 0
        if waiting:
            kept = best()
        if kept is not None:
            values = pa.array(kept["steps"].to_numpy() / 10.0**digits)
            out = pa.table([ids.take(kept["query"].combine_chunks()), kept["item_id"], values], ["query_id", "item_id", "bm25"])
            yield from out.combine_chunks().to_batches()

    return run


def _scores(items: pa.RecordBatch, own: list[np.ndarray], weights: np.ndarray, avgdl: float) -> np.ndarray:
    """The scores of a block of items, a row for each query."""
    terms, n = items["terms"], items.num_rows
    at, tf = np.asarray(terms.flatten()), np.asarray(items["tfs"].flatten())
    row = np.repeat(np.arange(n), np.asarray(terms.value_lengths().fill_null(0)))
    length = K1 * (1 - B + B * np.asarray(items["dl"]) / avgdl)
    parts = np.zeros((len(weights), n + 1))  # of a single column the terms would be summed in another order
    parts[at, row] = weights[at] * tf * (K1 + 1) / (tf + length[row])
    return np.array([parts[ts].sum(axis=0) for ts in own]).reshape(len(own), n + 1)[:, :n]


def bm25_of(indexed: DataFrame, query: Query) -> DataFrame:
    """item_id, bm25 of one query over its index; an exact query is one phrase, counted within columns."""
    words = [w for word in query.words for w in _index_words(word)]
    if query.exact:
        first = lambda h: text.runs_among(F.filter("marks", lambda m: m["weight"] == h), words)
        tf = sum((first(F.lit(2 * w)) * (2 * w) for w in COLUMN_WEIGHTS.values()), F.lit(0.0))
        posted = indexed.select("item_id", F.lit("").alias("term"), tf.alias("tf"), "dl").filter("tf > 0")
    else:
        posted = frequencies(indexed).filter(F.col("term").isin(words))
    df = document_frequency(posted).join(F.broadcast(collection(indexed)))
    # a row for each of the query's words
    return posted.join(F.broadcast(df), "term").groupBy("item_id").agg(F.sum(_part(idf(F.col("df")))).alias("bm25"))


def relevance(query: Query, bm25_normalised: Column) -> dict[str, Column]:
    """Lexical features of an indexed row, and their score."""
    n = float(max(1, len(query.distinct)))
    hits, words = F.col("hits"), list(query.words)
    title = F.filter(hits, lambda h: h["pos"] < F.col("n_title"))
    body = F.filter(hits, lambda h: (h["pos"] >= F.col("n_title")) & (h["pos"] < F.col("n_title") + F.col("n_text")))
    share = lambda part: F.size(F.array_intersect(F.array(*map(F.lit, query.distinct)), _terms(part))) / n
    coverage, title_coverage, body_coverage = share(hits), share(title), share(body)
    phrase, title_phrase, body_phrase = ((text.runs_among(part, words) > 0).cast("double") for part in (hits, title, body))
    near = text.cover_among(hits, list(query.distinct))
    exact = F.lit(0.0)
    if query.intent == "hashtag" and query.words:
        exact = F.array_contains(_tags(F.col("hashtags")), query.words[0]).cast("double")
    elif query.intent == "handle" and query.words:
        exact = (text.normalise(F.regexp_replace("handle", "^@", "")) == query.words[0]).cast("double")
    elif query.intent == "url" and query.normalised:
        exact = F.contains(text.normalise(F.col("canonical_url")), F.lit(query.normalised)).cast("double")
    exact = F.coalesce(exact, F.lit(0.0))
    score = 35 * coverage + 15 * title_coverage + 15 * phrase + 15 * title_phrase + 10 * near + bm25_normalised / 10 + 10 * exact
    return {
        "relevance": rounded(F.least(F.lit(100.0), score), 2),
        "coverage": rounded(100 * coverage, 2),
        "title_coverage": rounded(100 * title_coverage, 2),
        "body_coverage": rounded(100 * body_coverage, 2),
        "phrase": 100 * phrase,
        "title_phrase": 100 * title_phrase,
        "body_phrase": 100 * body_phrase,
        "proximity": rounded(100 * near, 2),
        "intent_exact": 100 * exact,
    }


def evidence(content: DataFrame, query: Query, keep: list[str]) -> DataFrame:
    """The candidates of a query with bm25_normalised, their lexical features, matched_terms and the columns `keep`."""
    kept = list(dict.fromkeys([*keep, "handle", "hashtags", "canonical_url"]))
    rows = _with_author(content)
    if query.intent == "hashtag":
        rows = rows.withColumn("literal_tags", literal_tags(F.col("title"), F.col("text")))
        kept.append("literal_tags")
    indexed = materialise(index(rows, list(query.distinct), kept), "index")
    found = indexed.filter(matches(query)).join(bm25_of(indexed, query), "item_id", "left")
    top = found.agg(F.max("bm25").alias("top"))  # one row
    norm = rounded(F.coalesce(F.try_divide(100 * F.coalesce("bm25", F.lit(0.0)), F.col("top")), F.lit(0.0)), 2)
    found = found.join(F.broadcast(top)).withColumn("bm25_normalised", norm)
    features = relevance(query, F.col("bm25_normalised"))
    return found.select("item_id", "bm25_normalised", *(c.alias(k) for k, c in features.items()), _found(query).alias("matched_terms"), *keep)


def final_score(parts: dict[str, Column], penalty: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum whose secondary signals count only as far as the item is relevant."""
    return explained(parts, penalty, weights)["score"]


def explained(parts: dict[str, Column], penalty: Column, weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """score, pre_penalty, factor and the weighted components of the final score."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("ranking weights must total 1")
    factor = rounded(F.pow(parts["relevance"] / 100, F.lit(2.0)), 4)
    weighted = {k: rounded(w * parts[k], 4) for k, w in weights.items()}
    rest = sum((v for k, v in weighted.items() if k != "relevance"), F.lit(0.0))
    before = weighted["relevance"] + factor * rest
    return {"score": rounded(numbers.clamp(before - penalty), 2), "pre_penalty": rounded(numbers.clamp(before), 2), "factor": factor} | {f"w_{k}": v for k, v in weighted.items()}


def resolved_weights(settings: dict[str, float]) -> dict[str, float]:
    """Stored weights if they are all there and total one, else the defaults."""
    own = {k: settings.get(k) for k in WEIGHTS}
    return own if all(isinstance(v, (int, float)) for v in own.values()) and abs(sum(own.values()) - 1) <= 1e-6 else dict(WEIGHTS)


def hybrid_score(parts: dict[str, Column], semantic: Column, penalty: Column, semantic_weight: float = 0.75, budget: float = 0.01, weights: dict[str, float] = WEIGHTS) -> Column:
    """Semantic relevance first; secondary signals share a small budget."""
    budget = min(0.05, max(0.0, budget))
    relevant = rounded((1 - semantic_weight) * parts["relevance"] + semantic_weight * semantic, 2)
    factor = rounded(F.pow(relevant / 100, F.lit(2.0)), 4)
    others = {k: w for k, w in weights.items() if k != "relevance"}
    quality = sum((w * parts[k] for k, w in others.items()), F.lit(0.0)) / sum(others.values())
    return rounded(numbers.clamp((1 - budget) * relevant + budget * factor * quality - penalty), 2)


def duplicate_signals(rows: DataFrame, key: Column) -> DataFrame:
    """rows with cross_source and novelty: copies by `key` over several sources, and whether a row is its group's newest.

    rows: item_id, source, published_at.  A row without copies is novel.
    """
    keyed = rows.withColumn("_key", key)
    order = F.struct(F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(-(1 << 62))), F.col("source"), F.col("item_id"))
    groups = keyed.groupBy("_key").agg(F.countDistinct("source").alias("_sources"), F.max_by("item_id", order).alias("_canonical"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    out = keyed.join(groups, "_key", "left")
    cross = F.when(F.col("_n").isNull(), 0.0).otherwise(numbers.cross_source(F.col("_sources")))
    return out.withColumns({"cross_source": cross, "novelty": F.when(F.col("_n").isNull() | (F.col("item_id") == F.col("_canonical")), 100.0).otherwise(40.0)}).drop("_key", "_sources", "_canonical", "_n")


def rank(content: DataFrame, query: Query, now: Column, engagement: Column, limit: int = 20, source_confidence: float = 70.0, copies: Column | None = None) -> DataFrame:
    """The best items for one query, with their score parts; with `copies`, copies of a text lose novelty and gain cross-source weight."""
    rows = _with_author(content).withColumns({"freshness": numbers.freshness(F.col("published_at"), now), "engagement": engagement, "spam": text.spam_penalty(F.col("title"), F.col("text"), F.col("canonical_url"))})
    if copies is not None:
        rows = rows.withColumn("copy_key", copies)
    keep = ["source", "published_at", "freshness", "engagement", "spam"] + (["copy_key"] if copies is not None else [])
    found = evidence(rows, query, keep)
    found = duplicate_signals(found, F.col("copy_key")) if copies is not None else found.withColumns({"cross_source": F.lit(0.0), "novelty": F.lit(100.0)})
    parts = {k: F.col(k) for k in ("relevance", "freshness", "engagement", "cross_source", "novelty")} | {"source_confidence": F.lit(source_confidence)}
    found = found.withColumns(explained(parts, F.col("spam")))
    best = found.orderBy(F.col("score").desc(), F.col("relevance").desc(), F.col("published_at").desc_nulls_last(), F.col("item_id").desc()).limit(limit)
    if copies is None:
        return best.select("item_id", "source", "bm25_normalised", "relevance", "proximity", "freshness", "engagement", "spam", "score")
    return best.select("item_id", "source", "score", "relevance", "cross_source", "novelty", "spam", "factor", "pre_penalty", *(f"w_{k}" for k in WEIGHTS), "matched_terms")


def fair_admission(rows: DataFrame, source: str, order: list[Column], identity: list[str], per_source: int, total: int) -> DataFrame:
    """Round-robin over sources: the best of each, then the second of each, up to a total.

    First-wins de-duplication by identity, a per-source top k (which Spark
    prunes before the sort), then an interleave.
    """
    first = Window.partitionBy(*identity).orderBy(*order)
    own = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    ranked = own.withColumn("source_rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).filter(F.col("source_rank") <= per_source)
    return ranked.orderBy("source_rank", source).limit(total)


def interleaved(rows: DataFrame, source: str, rank_column: str, limit: int, group: str | None = None) -> DataFrame:
    """Round-robin over sources in the order in which sources first appear in the ranking (of each group)."""
    outer = [group] if group else []
    w = Window.partitionBy(*outer, source)
    rows = rows.withColumn("source_rank", F.row_number().over(w.orderBy(rank_column))).withColumn("first_rank", F.min(rank_column).over(w))
    if not group:
        return rows.orderBy("source_rank", "first_rank").limit(limit)
    place = Window.partitionBy(group).orderBy("source_rank", "first_rank")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
