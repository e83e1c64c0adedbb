"""Query lattices, expansion by evidence and aliases, over tables of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from lodestream.functions import text
from lodestream.functions.numbers import rounded
from lodestream.sources.scratch import materialise

BROADCAST_ROWS = 100_000  # queries with their words, or words of variants
CELLS = 4_000_000  # of a matrix of rows by words or by queries

#: Words of temporal intent (fixed values).
HISTORICAL = ["history", "historical", "archive", "archived", "timeline", "تاريخ", "تاريخي", "ارشيف", "أرشيف"]
CRITICAL = ["latest", "breaking", "today", "now", "عاجل", "اليوم", "الان"]
RECENT = ["latest", "breaking", "today", "now", "recent", "new", "current", "احدث", "عاجل", "اليوم", "الان", "حديث"]
#: Words that expand nothing (fixed values).
COMMON = ["the", "and", "for", "with", "from", "this", "that", "news", "عن", "من", "في", "على", "الى", "إلى", "هذا", "هذه", "التي", "الذي"]
#: Names by their usual Latin spelling (fixed values).
NAMES = {"علي": "Ali", "فراس": "Firas", "محمد": "Mohammed", "محمود": "Mahmoud", "احمد": "Ahmed", "أحمد": "Ahmed", "رضا": "Reda", "حسن": "Hassan", "حسين": "Hussein", "عمر": "Omar", "بغداد": "Baghdad", "العراق": "Iraq"}
MOST_DRIFT, LEAST_ALIAS, LEAST_EXPANSION = 0.35, 0.8, 0.7


def temporal_intent(words: Column, original: Column, time_range: Column, identifier: Column) -> Column:
    """What a query wants of time: an explicit short range first, then words and years."""
    has = lambda terms: F.arrays_overlap(words, F.array(*map(F.lit, terms)))
    year = original.rlike(r"\b(19|20)[0-9]{2}\b")
    return (
        F.when(time_range == "24h", "TIME_CRITICAL").when(time_range == "7d", "RECENT_PREFERRED").when(has(HISTORICAL) | (year & ~identifier), "HISTORICAL")
        .when(has(CRITICAL), "TIME_CRITICAL").when(has(RECENT) | (time_range == "30d"), "RECENT_PREFERRED").otherwise("TIME_NEUTRAL")
    )


def transliterated(x: Column) -> Column:
    """A name of two to five known words in Latin letters; null for others."""
    words = F.split(F.trim(x), r"\s+")
    names = F.create_map(*(F.lit(v) for pair in NAMES.items() for v in pair))
    found = F.transform(words, lambda w: F.element_at(names, w))
    return F.when((F.size(words) >= 2) & (F.size(words) <= 5) & F.forall(found, lambda w: w.isNotNull()), F.array_join(found, " "))


def variant_id(kind: Column, x: Column, parent: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", kind, x, F.coalesce(parent, F.lit(""))), 256), 1, 20)


def build(queries: DataFrame, aliases: DataFrame | None = None, expansions: DataFrame | None = None, most: int = 6) -> DataFrame:
    """query_id, position, kind, text, confidence, drift, round, variant_id, parent_id of each query's variants.

    queries: query_id, original, and flags exact, person, entity, arabic,
    mixed, handle, hashtag, identifier.  The rules add, in this order, the
    original, its normal form, the quoted phrase, Arabic normal form, handle,
    hashtag, identifier, transliteration, aliases (by confidence) and
    expansions; identifiers take no aliases and no expansions.  Equal variants
    of one kind and parent count once, and the first `most` stay.
    """
    most = max(1, min(most, 12))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    single = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    clean = single(F.col("original"))
    bare = F.regexp_replace(F.col("original"), '^"+|"+$', "")
    rules = [
        (F.lit(True), "ORIGINAL", clean, 1.0, 0.0, 1), (F.lit(True), "NORMALIZED", text.normalise(F.col("original")), 0.98, 0.02, 1), (flag("exact") | flag("person") | flag("entity"), "EXACT", F.concat(F.lit('"'), bare, F.lit('"')), 0.97, 0.0, 1),
        (flag("arabic") | flag("mixed"), "ARABIC_NORMALIZED", text.normalise_arabic(F.col("original")), 0.96, 0.03, 1), (flag("handle"), "HANDLE", clean, 1.0, 0.0, 1), (flag("hashtag"), "HASHTAG", clean, 1.0, 0.0, 1),
        (flag("identifier"), "IDENTIFIER", clean, 1.0, 0.0, 1), (flag("person") & flag("arabic"), "TRANSLITERATION", transliterated(F.col("original")), 0.78, 0.18, 2),
    ]
    made = F.array(*(F.when(rule, F.struct(F.lit(k).cast("long").alias("place"), F.lit(kind).alias("kind"), x.alias("text"), F.lit(c).alias("confidence"), F.lit(d).alias("drift"), F.lit(r).alias("round"))) for k, (rule, kind, x, c, d, r) in enumerate(rules)))
    rows = queries.select("query_id", ~flag("identifier") & F.col("query_id").isNotNull(), F.explode(made)).toDF("query_id", "open", "v").filter("v is not null").select("query_id", "open", "v.*")
    none = F.lit(None).cast("boolean").alias("open")
    if aliases is not None:
        own = aliases.filter(F.col("confidence") >= LEAST_ALIAS)
        rows = rows.unionByName(own.select("query_id", none, F.lit(100).cast("long").alias("place"), F.lit("ENTITY_ALIAS").alias("kind"), "text", "confidence", F.greatest(F.lit(0.05), 1 - F.col("confidence")).alias("drift"), F.lit(2).alias("round")))
    if expansions is not None:
        own = expansions.filter((F.col("confidence") >= LEAST_EXPANSION) & (F.col("drift") <= MOST_DRIFT))
        rows = rows.unionByName(own.select("query_id", none, (10_000 + F.col("n")).cast("long").alias("place"), F.lit("EVIDENCE_EXPANDED").alias("kind"), "text", "confidence", "drift", F.lit(3).alias("round")))
    # every step is by query: its rows are dealt once
    own, first = Window.partitionBy("query_id"), ["place", F.col("confidence").desc(), "text"]
    said = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text"))).over(own)
    rows = rows.withColumns({"_open": F.max("open").over(own), "_root": said("ORIGINAL"), "_normal": said("NORMALIZED")}).filter((F.col("place") < 100) | F.col("_open"))
    rows = rows.withColumn("_text", single(F.col("text"))).filter(F.trim("text") != "")
    # parents follow from the kind, so variants of one kind and text are equal
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "kind", "_text").orderBy(*first))).filter("n = 1")
    rows = rows.withColumn("position", F.row_number().over(own.orderBy(*first))).filter(F.col("position") <= most)
    root = variant_id(F.lit("ORIGINAL"), F.col("_root"), F.lit(None).cast("string"))
    parent = F.when(F.col("kind") == "TRANSLITERATION", variant_id(F.lit("NORMALIZED"), F.col("_normal"), root)).when(F.col("kind") != "ORIGINAL", root)
    rows = rows.withColumn("parent_id", parent).withColumn("variant_id", variant_id(F.col("kind"), F.col("_text"), F.col("parent_id")))
    return rows.select("query_id", "position", "kind", F.col("_text").alias("text"), rounded(F.col("confidence"), 6).alias("confidence"), rounded(F.col("drift"), 6).alias("drift"), "round", "variant_id", "parent_id")


def secondary(lattice: DataFrame, round_no: int) -> DataFrame:
    """The variants a later round asks: exact, Arabic, transliterated and alias ones in the second, then the expansions of the round.

    Drifting ones stay out, and so do those that say what the original says.
    """
    return later(lattice).filter(F.col("asked") == round_no).drop("asked")


def later(lattice: DataFrame) -> DataFrame:
    """The variants of `secondary` of every round after the first, with asked, their round; a lattice as built is not dealt again."""
    root = F.max(F.when(F.col("kind") == "ORIGINAL", F.col("text"))).over(Window.partitionBy("query_id"))
    asked = F.when(F.col("kind").isin("EXACT", "ARABIC_NORMALIZED", "TRANSLITERATION", "ENTITY_ALIAS"), 2).when((F.col("kind") == "EVIDENCE_EXPANDED") & (F.col("round") > 2), F.col("round"))
    rows = lattice.withColumns({"root": root, "asked": asked}).filter(F.col("query_id").isNotNull() & F.col("asked").isNotNull() & (F.col("drift") <= MOST_DRIFT))
    bare = lambda c: F.lower(F.regexp_replace(c, '^"+|"+$', ""))
    differs = F.when(F.col("kind") == "EXACT", F.col("text") != F.col("root")).otherwise(bare("text") != bare("root"))
    return rows.filter(differs).drop("root")


def expansions(queries: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """query_id, n, term, text, n_results, n_sources, confidence, drift, accepted: the best supported terms of each query's results.

    queries: query_id, original, closed (no expansion).  evidence: query_id,
    result_id (source:id), text.  A term is a run of letters, digits, dots and
    hyphens of four or more, no word of the query and no number; it is shown as
    its least spelling.  Accepted are distinctive terms of three results from
    two sources or more.
    """
    open_ = queries.filter(~F.coalesce("closed", F.lit(False))).select("query_id", "original", text.tokens(F.col("original")).alias("own"))
    raw = evidence.select("query_id", "result_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[#@]?[\p{L}\p{N}_.-]+"), F.lit(0)))).alias("raw"))
    raw = raw.withColumn("term", text.normalise(F.col("raw"))).filter((F.length("term") >= 4) & ~F.col("term").isin(COMMON) & ~F.col("term").rlike(r"^\p{N}+$"))
    # results of one query are most of a table: they are not dealt by their query, as long as the queries can be sent to them
    open_ = materialise(open_, "open-queries")
    rows = raw.join(F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_, "query_id").filter(~F.array_contains("own", F.col("term")))
    a = rows.groupBy("query_id", "original", "term").agg(F.countDistinct("result_id").alias("n_results"), F.countDistinct(F.split_part("result_id", F.lit(":"), F.lit(1))).alias("n_sources"), F.min("raw").alias("raw"))
    best = a.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_results").desc(), "term"))).filter(F.col("n") <= max(1, min(most, 3)))
    distinctive = F.col("raw").rlike("^[#@]") | F.col("raw").rlike(r"[\p{N}.\-؀-ۿ]") | ((F.length("raw") >= 6) & F.col("raw").rlike(r"\p{Lu}"))
    confidence = F.least(F.lit(0.92), 0.52 + 0.1 * F.col("n_results") + 0.06 * F.col("n_sources"))
    best = best.withColumns({"confidence": rounded(confidence, 6), "drift": F.when(F.col("n_sources") >= 3, 0.22).otherwise(0.3)})
    accepted = distinctive & (F.col("n_results") >= 3) & (F.col("n_sources") >= 2) & (F.col("confidence") >= 0.78)
    return best.select("query_id", "n", "term", F.concat_ws(" ", "original", "raw").alias("text"), "n_results", "n_sources", "confidence", "drift", accepted.alias("accepted"))


def alias_edges(observed: DataFrame) -> DataFrame:
    """left, right, relation, support, confidence, status of every pair of names observed.

    observed: left, right, relation, evidence_source, direct, seq (a total
    order).  Each further source adds one to the support and a tenth to the
    confidence, which is at most 0.98; it starts at 0.8 with direct evidence,
    else 0.55, and the first direct observation later lifts it to 0.8.  Pairs
    with at least two sources and 0.8 are supported.
    """
    rows = observed.withColumns({"left": text.normalise(F.col("left")), "right": text.normalise(F.col("right"))}).filter("left <> '' and right <> '' and left <> right and length(left) <= 300 and length(right) <= 500")
    key = ["left", "right", "relation"]
    fresh = rows.withColumn("fresh", (F.row_number().over(Window.partitionBy(*key, "evidence_source").orderBy("seq")) == 1).cast("int"))
    # folding by steps: confidence = max over the observations of their floor plus a tenth for each fresh source from there on
    w = Window.partitionBy(*key).orderBy("seq")
    before = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = fresh.withColumn("upto", before).withColumn("first", F.row_number().over(w) == 1)
    total = Window.partitionBy(*key)
    steps = steps.withColumn("after", F.sum("fresh").over(total) - F.col("upto") + F.when(F.col("first"), 0).otherwise(F.col("fresh")))
    reach = F.when(F.col("direct"), 0.8).otherwise(0.55) + 0.1 * F.col("after")
    a = steps.groupBy(*key).agg(F.sum("fresh").alias("support"), F.least(F.lit(0.98), F.max(reach)).alias("c"))
    c = rounded(F.col("c"), 6)
    return a.select(*key, "support", c.alias("confidence"), F.when((F.col("support") >= 2) & (c >= 0.8), "supported").otherwise("observed").alias("status"))


def admissible_aliases(edges: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """query_id, alias, confidence: the supported other names of each query's words, the surest first."""
    sure = edges.filter((F.col("status") == "supported") & (F.col("confidence") >= LEAST_ALIAS) & (F.col("support") >= 2))
    q = queries.select("query_id", text.normalise(F.col("original")).alias("q"))
    both = q.join(sure, F.col("q") == F.col("left")).select("query_id", F.col("right").alias("alias"), "confidence", "right").unionByName(q.join(sure, F.col("q") == F.col("right")).select("query_id", F.col("left").alias("alias"), "confidence", "right"))
    w = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "right", "alias")
    return both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("query_id", "n", "alias", "confidence")


def matches_any(rows: DataFrame, lattice: DataFrame, key: str = "item_id") -> DataFrame:
    """key, query_id of the rows that a variant of little drift matches, by enough of its words.

    rows: key, words (an array, or the text to cut into them), evidence (folded
    text).  A query whose variants include an identifier, but no handle and no
    hashtag, is matched only by that identifier standing in the evidence, all
    its words among the row's.  Up to BROADCAST_ROWS words of variants are sent
    to the rows, and no row stands for a pair of row and variant; more words,
    and rows that share their key, meet in a join.
    """
    kinds = lattice.groupBy("query_id").agg(F.max((F.col("kind") == "IDENTIFIER").cast("int")).alias("i"), F.max(F.col("kind").isin("HANDLE", "HASHTAG").cast("int")).alias("o"))
    v = lattice.join(kinds, "query_id").filter(F.col("drift") <= MOST_DRIFT)
    literal = (F.col("i") == 1) & (F.col("o") == 0)
    v = v.filter(~literal | (F.col("kind") == "IDENTIFIER")).withColumn("needle", F.when(literal, text.folded(F.col("text"))))
    v = v.withColumn("ws", F.array_distinct(text.tokens(F.col("text")))).filter(F.size("ws") > 0)
    needed = F.when(literal | (F.size("ws") <= 2), F.size("ws")).otherwise(F.ceil(F.size("ws") * 0.6))
    each = materialise(v.select("query_id", "variant_id", "needle", needed.cast("int").alias("needed"), F.explode("ws").alias("word")), "variants")
    known = each.limit(BROADCAST_ROWS + 1).collect()
    if len(known) > BROADCAST_ROWS:
        return _joined(rows, each, key)
    again = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("again")), "repeated")
    same = F.col(key).eqNullSafe(F.col("again"))
    kind = each.schema["query_id"].dataType
    found = F.arrow_udf(_matched(known, to_arrow_type(kind)), f"array<{kind.simpleString()}>", F.ArrowUDFType.SCALAR)
    once = rows.join(again, same, "left_anti").select(key, F.explode(found("words", "evidence")).alias("query_id"))
    return once.unionByName(_joined(rows.join(again, same, "left_semi"), each, key))


def _joined(rows: DataFrame, each: DataFrame, key: str) -> DataFrame:
    words = F.col("words") if isinstance(rows.schema["words"].dataType, ArrayType) else text.tokens(F.col("words"))
    hits = rows.select(key, F.explode(F.array_distinct(words)).alias("word")).join(each, "word").groupBy(key, "query_id", "variant_id", "needle", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n >= needed")
    plain = hits.filter("needle is null").select(key, "query_id")
    exact = hits.filter("needle is not null").join(rows.select(key, "evidence"), key).filter(F.contains("evidence", F.col("needle"))).select(key, "query_id")
    return plain.unionByName(exact).distinct()


def _matched(known: list, kind: pa.DataType):
    """The queries that each row matches, from the words of the variants."""
    place: dict[str, int] = {}
    made: dict[tuple, set[int]] = {}
    for r in known:
        made.setdefault((r.query_id, r.variant_id, r.needle, r.needed), set()).add(place.setdefault(r.word, len(place)))
    # variants that ask the same of a row are one
    variants = sorted({(q, needle, needed, tuple(sorted(ts))) for (q, _, needle, needed), ts in made.items()}, key=lambda v: v[3])
    queries = list(dict.fromkeys(q for q, *_ in variants))
    ids, at = pa.array(queries, kind), {q: i for i, q in enumerate(queries)}
    wanted = [(at[q], needle, needed, np.array(ts)) for q, needle, needed, ts in variants]
    size = max(1, CELLS // max(1, len(place), len(queries)))

    def run(words: pa.Array, evidence: pa.Array) -> pa.Array:
        rows, asked = [], []
        for begin in range(0, len(words), size):
            some = words.slice(begin, size)
            n = len(some)
            there = np.zeros((len(place), n), np.uint8)
            for k, x in enumerate(some.to_pylist()):
                own = x if isinstance(x, list) else text.words_of(x)[0]
                there[[place[w] for w in set(own) if w in place], k] = 1
            hit = np.zeros((n, len(queries)), bool)
            for query, needle, needed, ts in wanted:
                enough = there[ts].sum(axis=0, dtype=np.int32) >= needed
                if needle is not None:
                    for k in np.flatnonzero(enough):
                        enough[k] = needle in (evidence[begin + k].as_py() or "")
                hit[:, query] |= enough
            row, query = np.nonzero(hit)
            rows.append(np.bincount(row, minlength=n))
            asked.append(query)
        ends = np.cumsum(np.concatenate([[0], *rows]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(np.concatenate(asked) if asked else [], pa.int64())))

    return run
