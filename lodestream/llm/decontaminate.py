"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a short window and ignore the others, so
a window still matches where an ignored word was substituted.  Seeds of test
and training texts meet in a hash join; around each hit the two texts are laid
on the diagonal the hit names, and the longest overlap with enough equal words
is measured.

Scale.  The corpus side would give several seeds a word, so a bit table of the
test side's seeds (its size is fixed) drops what cannot match before anything
leaves the task; a handful of rows per contaminated text is joined exactly.
The second look reads the texts of hit documents only; what goes to every
executor for it is ids and diagonals, within a byte bound, else it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import WordHasher, ascii_lower_table, materialise, mix, null_to_empty, slices, stream, utf8

#: 1: the word counts, 0: it is ignored.
#: At the defaults below every overlap holds one of them, wherever its substitutions are.
MASKS = ("11111", "110111", "111011", "1101101")
#: Test texts under MIN_OVERLAP words have these as well: five words in a row with one substituted hold one of them.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Test texts under five words have one of these, all their words.
TINY_MASKS = ("1", "11", "111", "1111")
MIN_OVERLAP = 13  # words; of a shorter test text all of it
PERCENT = 80  # equal words in the overlap
FILTER_BITS = 26  # 8 MB as bits
BROADCAST_ROWS = 1_000_000  # seeds, of 24 bytes
BROADCAST_BYTES = 64_000_000
_GAPS = bytes(b for b in range(1, 128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


class _Seeds:
    """Word hashes and seeds; texts are lower-cased, words are letters and digits."""

    def __init__(self, masks: tuple[str, ...]):
        self.hasher = WordHasher(ascii_lower_table(_GAPS))
        self.masks = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
        self.factors = stream(16, 21) | np.uint64(1)
        self.tags = stream(len(masks), 22)

    def words(self, texts: pa.Array):
        lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string())
        return self.hasher.words(*utf8(lowered))[:2]

    def seeds(self, hashes: np.ndarray, used: Iterable[int]) -> Iterator[np.ndarray]:
        """For each mask used the seed at each word where it fits."""
        for places, tag in ((self.masks[m], self.tags[m]) for m in used):
            n = max(0, len(hashes) - places[-1])
            total = np.full(n, tag)
            for j, p in enumerate(places):
                total = total + hashes[p : p + n] * self.factors[j]
            yield mix(total)


def longest(equal: np.ndarray, percent: int, equal_ends: bool = False) -> tuple[int, int]:
    """Longest stretch with at least percent equal: (begin, end), the first of equal ones.

    With equal_ends only stretches that begin and end on an equal place count.
    """
    s = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    begins = ends = s
    if equal_ends:
        begins = np.append(np.where(equal, s[:-1], s.max() + 1), s.max() + 1)
        ends = np.insert(np.where(equal, s[1:], s.min() - 1), 0, s.min() - 1)
    least = np.minimum.accumulate(begins)
    best, at = 0, (0, 0)
    most = np.maximum.accumulate(ends[::-1])[::-1]
    i = j = 0
    n = len(s)
    while j < n and i < n:  # both accumulations are monotone, so two pointers meet every longest stretch
        if most[j] >= least[i]:
            if j - i > best:
                best, at = j - i, (i, j)
            j += 1
        else:
            i += 1
    return at


def overlap_at(equal: np.ndarray, item_words: int, min_overlap: int, percent: int) -> tuple[int, int]:
    """The overlap on a diagonal as (begin, end), (0, 0) without one; equal has the places where both texts have words."""
    if item_words <= min_overlap:  # all of the test text or nothing
        whole = len(equal) == item_words and 100 * int(equal.sum()) >= percent * item_words
        return (0, item_words) if whole else (0, 0)
    b, e = longest(equal, percent, equal_ends=True)
    return (b, e) if e - b >= min_overlap else (0, 0)


def test_seeds(tests: DataFrame, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """seed, item_id, item_pos, mask (number) of the test texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Seeds((*masks, *short_masks, *TINY_MASKS))
        few = len(masks) + len(short_masks)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, rows = own.words(batch.column(1)[a:b])
                ids = batch.column(0)[a:b].to_pylist()
                for item, lo, hi in zip(ids, rows[:-1], rows[1:]):
                    n = int(hi - lo)
                    if not n:
                        continue
                    used = range(few + n - 1, few + n) if n <= len(TINY_MASKS) else range(few if n < min_overlap else len(masks))
                    for mask, seeds in zip(used, own.seeds(hashes[lo:hi], used)):
                        yield pa.RecordBatch.from_pydict({"seed": pa.array(seeds.view(np.int64), pa.int64()), "item_id": pa.array([item] * len(seeds), pa.int64()), "item_pos": pa.array(range(len(seeds)), pa.int32()), "mask": pa.array([mask] * len(seeds), pa.int32())})

    return tests.select(F.col("item_id").cast("long").alias("item_id"), null_to_empty().alias("text")).mapInArrow(run, "seed long, item_id long, item_pos int, mask int")


def corpus_hits(docs: DataFrame, seeds: DataFrame, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS) -> DataFrame:
    """uid, seed, pos where a corpus seed is in the test side's bit table (a superset of the matches)."""
    size = 1 << FILTER_BITS
    places = seeds.select(F.expr(f"shiftrightunsigned(seed, {64 - FILTER_BITS})").alias("p"))
    words = places.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)  # 8 MB, whatever the size of either side
    table[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    few = len(masks) + len(short_masks)
    used = sorted(r.mask for r in seeds.select("mask").distinct().collect())  # the short ones only where a test text needs them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Seeds((*masks, *short_masks, *TINY_MASKS))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, rows = own.words(batch.column(1)[a:b])
                uid = batch.column(0)[a:b].to_numpy()
                for mask, seeds in zip(used, own.seeds(hashes, used)):
                    places = own.masks[mask]
                    p = seeds >> np.uint64(64 - FILTER_BITS)
                    at = np.flatnonzero(table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1))
                    row = np.searchsorted(rows, at, side="right") - 1
                    whole = at + places[-1] < rows[row + 1]
                    at, row = at[whole], row[whole]
                    if mask >= few and len(at):  # a test text of few words: its first place in each document says all
                        _, first = np.unique(np.stack([row.astype(np.uint64), seeds[at]]), axis=1, return_index=True)
                        at, row = at[first], row[first]
                    if len(at):
                        yield pa.RecordBatch.from_pydict({"uid": pa.array(uid[row], pa.int64()), "seed": pa.array(seeds[at].view(np.int64), pa.int64()), "pos": pa.array((at - rows[row]).astype(np.int32), pa.int32())})

    return docs.select("uid", "text").mapInArrow(run, "uid long, seed long, pos int")


def overlaps(docs: DataFrame, tests: DataFrame, min_overlap: int = MIN_OVERLAP, percent: int = PERCENT, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS) -> DataFrame:
    """doc_id, item_id, overlap, equal, item_words, begin, end: one row for each document and test text that overlap.

    An overlap is min_overlap words or more with at least percent of them
    equal, place by place; begin and end count words of the document.  It is
    the longest such stretch of any diagonal that begins and ends on an equal
    word, the first of equal ones.  Of a test text of min_overlap words or
    fewer it is all words, whichever of them are unequal; under five words all
    have to be equal, and the first place in the document is reported.
    Null and empty test texts and null item ids match nothing; every text of an
    item_id is tested by itself, and equal rows of the tests count once.
    Documents that repeat are reported once per row; a null doc_id keeps its
    row.  Other columns are ignored.
    """
    return _overlaps(docs, tests, min_overlap, percent, masks, short_masks).drop("uid", "uid2")


def _row_keys() -> list[Column]:
    """Two hashes of a row's id and text: rows that share them have the same overlaps."""
    own = [F.col("doc_id"), null_to_empty(), F.col("doc_id").isNull()]
    return [F.xxhash64(*own).alias("uid"), F.xxhash64(F.lit("row"), *own).alias("uid2")]


def _overlaps(docs: DataFrame, tests: DataFrame, min_overlap: int = MIN_OVERLAP, percent: int = PERCENT, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS) -> DataFrame:
    """`overlaps` with uid and uid2, the row keys of the document."""
    tests = tests.select(F.col("item_id").cast("long").alias("own_item"), F.col("text").alias("item")).filter("own_item is not null and item is not null").distinct()
    tests = tests.withColumn("item_id", F.xxhash64("own_item", "item"))
    corpus = docs.select("doc_id", null_to_empty().alias("text"), *_row_keys())
    seeds = materialise(test_seeds(tests.select("item_id", F.col("item").alias("text")), masks, short_masks, min_overlap), "seeds")
    count = seeds.count()
    hits = corpus_hits(corpus, seeds, masks, short_masks)
    places = seeds.drop("mask")
    matched = hits.join(F.broadcast(places) if count <= BROADCAST_ROWS else places, "seed")
    diagonals = matched.select("uid", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    found = materialise(diagonals.groupBy("uid", "item_id").agg(F.collect_list("shift").alias("shifts")), "diagonals")
    size = found.agg(F.coalesce(F.sum(F.size("shifts") * 4 + 40), F.lit(0))).first()[0]
    look = corpus.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "uid")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("item") + 40), F.lit(0))).first()[0]
    pairs = look.join(F.broadcast(tests) if size <= BROADCAST_BYTES else tests, "item_id").select("doc_id", "text", "own_item", "item", "shifts", "uid", "uid2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Seeds((*masks, *short_masks))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                words, rows = own.words(part.column(1))
                tested, item_rows = own.words(part.column(3))
                out = []
                for i, (doc, item, shifts, *keys) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 2, 4, 5, 6)))):
                    text, test = words[rows[i] : rows[i + 1]], tested[item_rows[i] : item_rows[i + 1]]
                    best = None
                    for shift in sorted(shifts):
                        lo, hi = max(0, -shift), min(len(test), len(text) - shift)
                        equal = test[lo:hi] == text[lo + shift : hi + shift]
                        b, e = overlap_at(equal, len(test), min_overlap, percent)
                        if e > b and (best is None or e - b > best[2]):
                            best = (doc, item, e - b, int(equal[b:e].sum()), len(test), lo + shift + b, lo + shift + e, *keys)
                    if best:
                        out.append(best)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "overlap", "equal", "item_words", "begin", "end", "uid", "uid2"])

    return pairs.mapInArrow(run, "doc_id long, item_id long, overlap long, equal long, item_words long, `begin` long, `end` long, uid long, uid2 long")


def remove_contaminated(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """docs without the rows whose text overlaps a test text; rows equal in id and text go together, others are decided alone."""
    hit = _overlaps(docs, tests, **how).select("uid", "uid2").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("own"), *_row_keys())
    return keyed.join(hit, ["uid", "uid2"], "left_anti").select("own.*")
