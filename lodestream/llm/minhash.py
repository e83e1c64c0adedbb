"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 120 hash evaluations yield 240 values.  Six of them (three
permutations) make a band and 40 bands a signature: two texts at similarity
0.8 share a band with probability above 0.99999.  Candidates are confirmed on
the full shingle sets.

Scale.  Equal sets are one class before anything is paired.  In a band bucket
members are compared with the bucket's smallest class only, first one pair per
class, then the pairs that still join different components.  What is left of a
bucket that spans several components is searched exactly by an ordered prefix
filter over those classes, so no bucket is expanded into all its pairs and no
link is lost to a cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SPACES, WordHasher, ascii_lower_table, materialise, mix, null_to_empty, shingle_sets, stream
from lodestream.operators.graph import components

BANDS, PER_BAND = 40, 3
HOT_SHARE = 2_000
BEFORE = 32  # items in front of one that a row of the exact search carries


def _signatures(n_words: int, bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_lower_table(SPACES))
        k = bands * per_band
        a, b = stream(k, 11) | np.uint64(1), stream(k, 12)
        weights = stream(2 * per_band, 13) | np.uint64(1)
        tag = stream(bands, 14)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets(hasher, batch.column(1), n_words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    keys.append(None)
                    continue
                low = high = None
                for i in range(0, len(s), 512):
                    h = s[i : i + 512, None] * a + b
                    lo, hi = h.min(axis=0), h.max(axis=0)
                    low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
                both = np.concatenate([low.reshape(bands, per_band), high.reshape(bands, per_band)], axis=1)
                keys.append(mix((mix(both) * weights).sum(axis=1, dtype=np.uint64) + tag).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def signatures(docs: DataFrame, n_words: int = 2, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its band keys (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text")).mapInArrow(
        _signatures(n_words, bands, per_band), "doc_id long, n_shingles long, digest binary, bands array<long>"
    )


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_lower_table(SPACES))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = list(shingle_sets(hasher, part.column(1), n_words))
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), digests, items], ["id", "digest", "items"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    A group of near copies pairs all its members with one representative.  An
    `a` with more than one in HOT_SHARE of all pairs (fewer than HOT_SHARE can
    have that) is dealt over as many salts as it has such shares, and its set
    is copied to each, so no task gets a group; the copies are HOT_SHARE at
    most, and as many sets again.
    """
    pairs = materialise(pairs, "pairs")
    total = pairs.count()
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > F.lit(total)).filter("n > 1")
    hot = F.broadcast(materialise(hot.select("a", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).alias("salts")), "hot"))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("salt"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x")).join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    both = dealt.join(left, ["a", "salt"]).join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.filter(100 * shared.cast("long") >= percent * union).select("a", "b")


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with table by key, where table's n is the number of rows with a key.

    Keys with more than one in HOT_SHARE of all rows, of which there are fewer
    than HOT_SHARE, go by broadcast, so none meets in one task.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(table.filter(F.col(n) * HOT_SHARE > F.lit(total)).filter(F.col(n) > 1))
    rest = rows.join(hot.select(key), key, "left_anti").join(table, key)
    return rows.join(hot, key).unionByName(rest)


def _stars(comp: DataFrame) -> DataFrame:
    """Links that make the same components: each member and its component."""
    return comp.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def _labelled(ids: DataFrame, comp: DataFrame) -> DataFrame:
    return ids.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _rest(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact search between components that share a bucket.

    mixed: (id, component, minor) of the classes in buckets that span several
    components; minor marks those outside the bucket's largest component.
    Two sets reach the similarity only if they share an item among the first
    size - needed + 1 of each, in one fixed order (rarest first); `needed`
    depends on both sizes, which the join condition checks together with the
    positions and components.
    """
    items = mixed.join(sets, "id").select("id", "component", "minor", F.explode("items").alias("item"), F.size("items").alias("n"))
    # items of one set only match nothing: they take the first places, so positions start after them
    seen = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    order = items.join(seen, "item").groupBy("id", "component", "minor", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("o")).withColumn("lead", F.col("n") - F.size("o"))
    # the longest prefix any partner can ask for: the partner is as small as the similarity allows
    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("lead")).cast("int")
    own = order.select("id", "component", "minor", "n", "lead", F.transform(F.slice("o", F.lit(1), keep), lambda x: x["item"]).alias("p"))
    rows = own.select("id", "component", "minor", "n", "lead", "p", F.posexplode("p").alias("k", "item"))
    before = F.slice("p", F.greatest(F.lit(1), F.col("k") + 1 - BEFORE), F.least(F.col("k"), F.lit(BEFORE)))
    prefix = materialise(rows.select("id", "component", "minor", "n", (F.col("lead") + F.col("k")).alias("pos"), before.alias("earlier"), "item"), "prefix")
    left = prefix.filter("minor").select("item", F.col("id").alias("p"), F.col("component").alias("pc"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("earlier").alias("pe"))
    needed = f"ceil({percent} * (pn + n) / {100 + percent})"
    # a pair counts at its first common item: one with a common item among those before has been met there
    found = left.join(prefix, "item").filter(f"pc <> component and pp <= pn - {needed} and pos <= n - {needed} and not arrays_overlap(pe, earlier)")
    return found.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()


def _class_of(rows: DataFrame) -> DataFrame:
    """doc_id, id: the smallest doc_id with the same digest."""
    classes = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    return looked_up(rows.select("doc_id", "digest"), classes, "digest", "n").select("doc_id", "id")


def near_duplicates(docs: DataFrame, n_words: int = 2, percent: int = 80, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Words are separated by white space and A-Z lower-cased.  Null and empty
    texts have the empty set and link with nothing.  Repeated rows are one
    document; where a doc_id repeats with other words, the text whose digest is
    smallest stands for it and all its rows get that component.  A null doc_id
    links with nothing (component_id null, kept true).  Other columns are ignored.
    """
    sig = materialise(signatures(docs, n_words, bands, per_band), "signatures")
    known = sig.filter("doc_id is not null")
    repeated = known.groupBy("doc_id").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = not repeated.isEmpty()
    if repeats:
        known = known.join(repeated, "doc_id", "left").filter("least is null or digest = least").dropDuplicates(["doc_id"])
    with_sets = known.filter("bands is not null")
    classes = with_sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    keys = materialise(classes.select("id", F.explode("bands").alias("key")), "keys")
    buckets = materialise(keys.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("rep < top").select("key", "rep", "n"), "reps")
    member = materialise(looked_up(keys, buckets, "key", "n").drop("n"), "buckets")  # the classes in buckets of two or more
    pairs = member.filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    wanted = member.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), null_to_empty().alias("text")).join(wanted, "id", "left_semi")
    sets = texts.mapInArrow(_sets(n_words), "id long, digest binary, items array<long>")
    if repeats:
        sets = sets.join(known.select(F.col("doc_id").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    sets = materialise(sets.select("id", "items"), "sets")

    once = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(confirm(once, sets, percent), "links")
    comp = materialise(components(links), "components")
    of_a, of_b = (comp.select(F.col("id").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    open_pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    more = materialise(confirm(open_pairs.join(once, ["a", "b"], "left_anti"), sets, percent), "links")
    if not more.isEmpty():
        comp = materialise(components(_stars(comp).unionByName(more)), "components")
    labelled = _labelled(member.select("key", "id"), comp)
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = labelled.join(spans, "key").groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("minor"))
    mixed = materialise(mixed, "mixed")
    if not mixed.isEmpty():
        extra = materialise(confirm(_rest(mixed, sets, percent), sets, percent), "links")
        if not extra.isEmpty():
            comp = components(_stars(comp).unionByName(extra))

    found = _labelled(_class_of(with_sets), comp).select("doc_id", "component")
    out = sig.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
