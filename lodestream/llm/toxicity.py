"""Toxicity: a counterfactual-regularised linear classifier.

Features are the words of a text and their first four and six bytes, hashed;
each counts once a text.  A logistic model with an L1 penalty is fitted on a
bounded sample of labelled rows.  For sentences that name a group the identity
term is swapped for another of its kind, and a sentence without one gets a
neutral mention; the squared change of the score under the swap is part of the
loss (on the logit of the score), so group names alone do not raise a score.

Scoring is one pass without a shuffle: the model is at most MAX_FEATURES
weights, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import WordHasher, ascii_lower_table, materialise, null_to_empty, slices, utf8

BITS = 20
PREFIXES = (4, 6)
MAX_TRAIN = 12_000  # labelled documents the model is fitted on, by hash of doc_id
MAX_TRAIN_CHARS = 48_000_000  # of all their texts together: what reaches the driver is a few numbers a word
MAX_FEATURES = 4096
THRESHOLD = 0.3
#: Kinds of identity terms; a term is swapped for the next of its kind.
IDENTITY = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "religions": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    "gender": ["woman", "man"],
    "genders": ["women", "men"],
    "orientation": ["gay", "straight", "lesbian", "bisexual"],
    "origin": ["black", "white", "asian", "latino", "arab", "african", "european"],
    "origins": ["immigrants", "natives", "foreigners", "citizens"],
    "age": ["old", "young"],
    "disability": ["deaf", "blind", "disabled"],
    "fr": ["musulman", "chrétien", "juif"],
    "de": ["muslime", "christen", "juden"],
    "es": ["musulmán", "cristiano", "judío"],
}
#: Separators of words: every ASCII byte that is no letter or digit.
_GAPS = bytes(b for b in range(1, 128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


class _Features:
    def __init__(self):
        self.hasher = WordHasher(ascii_lower_table(_GAPS))

    def many(self, texts: pa.Array):
        """(features of each word: a matrix of kinds by words, first word of each row and the end)."""
        hashes, rows, _, _, cut = self.hasher.words(*utf8(texts), PREFIXES)
        return np.stack([hashes, *cut]) >> np.uint64(64 - BITS), rows

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        out = []
        for a, b in slices(texts):
            found, rows = self.many(texts[a:b])
            out += [np.unique(found[:, i:j]).astype(np.int32) for i, j in zip(rows[:-1], rows[1:])]
        return out


def _swaps(identity: dict[str, list[str]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    pairs = [(t, kind[(i + 1) % len(kind)]) for kind in identity.values() for i, t in enumerate(kind)]
    return dict(pairs), pairs


@dataclass
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray


def _examples(rows: DataFrame, identity: dict[str, list[str]]) -> pa.Table:
    """label, features, and the features that go and come when the identity terms are swapped, of the training rows."""
    swap, pairs = _swaps(identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        features = _Features()
        names = regex.compile(r"\b(?:" + "|".join(map(regex.escape, sorted(swap, key=len, reverse=True))) + r")\b", regex.I) if swap else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain, other = [], []
            for i, text in enumerate(texts):
                changed = names.sub(lambda m: swap[m[0].lower()], text) if names else text
                if names and changed == text:  # no group named: the same sentence about either of two groups
                    a, b = pairs[len(text) % len(pairs)]
                    text, changed = f"{text}\n{a}", f"{text}\n{b}"
                plain.append(text)
                other.append(changed)
            own, before, after = (features.sets(pa.array(x, pa.string())) for x in (texts, plain, other))
            gone, come = [np.setdiff1d(b, a) for b, a in zip(before, after)], [np.setdiff1d(a, b) for b, a in zip(before, after)]
            columns = [pa.array([s.astype(np.int32).tobytes() for s in x], pa.binary()) for x in (own, gone, come)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["label", "x", "gone", "come"])

    return rows.select(F.col("toxic").cast("int").alias("label"), null_to_empty().alias("text")).mapInArrow(run, "label int, x binary, gone binary, come binary").toArrow()


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number (of the batch) and feature of everything in a column of packed 32-bit numbers, without an object a row."""
    lengths = np.asarray(pc.binary_length(column)) // 4
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.int32)[offsets[0] // 4 : offsets[-1] // 4] if data else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(column), dtype=np.int32), lengths), values


def _design(found: pa.Table, name: str, kept: np.ndarray):
    """Row and column numbers of the kept features, a thousand examples at a time."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows, columns, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in found.to_batches(1000):
        row, values = _flat(batch.column(batch.schema.get_field_index(name)))
        at = place[values]
        rows.append(row[at >= 0].astype(np.int64) + before)
        columns.append(at[at >= 0].astype(np.int64))
        before += batch.num_rows
    return np.concatenate(rows), np.concatenate(columns)


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """text and toxic of at most max_train labelled documents with at most max_chars characters in all.

    Documents come by hash of doc_id until a bound is met; none is of the
    held-out fold.  A doc_id is one example however often it is repeated: the
    largest of its labels, the least of its texts by length and hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text"))
    which = F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(which).alias("t"))
    # at most max_train rows of a few numbers meet in this window
    running = F.sum("t.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = materialise(one.withColumn("chars", running).filter(F.col("chars") <= max_chars).select("doc_id", "toxic", "t.n", "t.h"), "sample")
    same = rows.withColumns({"n": F.length("text"), "h": F.xxhash64("text")}).join(F.broadcast(one), ["doc_id", "n", "h"])
    return same.groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, identity: dict[str, list[str]] = IDENTITY, l1: float = 2e-4, swap_weight: float = 1.0, rounds: int = 400, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fits the model on the bounded `sample` of labelled documents outside the held-out fold.

    The loss is logistic, plus swap_weight times the squared change of the
    score's logit under the swap of identity terms, plus an L1 penalty.  Null
    labels and null ids are no examples; without any example nothing is known
    to be toxic, and every text scores 0 (to 26 digits).
    """
    found = _examples(sample(docs, labels, max_train, max_chars), identity)
    y = np.array(found["label"].to_pylist(), np.float64)
    if not len(y):
        return Model(-60.0, np.zeros(0, np.int32), np.zeros(0))
    size = 1 << BITS
    total, toxic, before = np.zeros(size), np.zeros(size), 0
    for batch in found.to_batches(1000):
        row, values = _flat(batch.column(batch.schema.get_field_index("x")))
        total += np.bincount(values, minlength=size)
        toxic += np.bincount(values, y[before + row], size)
        before += batch.num_rows
    rate = y.mean()
    spread = (toxic - rate * total) ** 2 / np.maximum(total * rate * (1 - rate), 1e-9)
    spread[total < 3] = 0
    kept = np.sort(np.argsort(-spread, kind="stable")[:MAX_FEATURES])
    kept = kept[spread[kept] > 0].astype(np.int32)

    n, d = len(y), len(kept)
    row, col = _design(found, "x", kept)
    (r1, c1), (r2, c2) = _design(found, "gone", kept), _design(found, "come", kept)
    del found
    # the largest curvature of the loss, by power iteration, gives the step
    u = np.ones(d + 1)
    for _ in range(30):
        u /= np.linalg.norm(u) or 1.0
        z = np.bincount(row, u[col], n) + u[d]
        moved = np.bincount(r1, u[c1], n) - np.bincount(r2, u[c2], n)
        bend = 0.25 * np.bincount(col, z[row], d) + 2 * swap_weight * (np.bincount(c1, moved[r1], d) - np.bincount(c2, moved[r2], d))
        u = np.append(bend, 0.25 * z.sum()) / n
    step = 1 / (1.1 * np.linalg.norm(u) + 1e-9)
    w = v = np.zeros(d)
    bias = bias_v = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    t = 1.0
    for _ in range(rounds):
        z = bias_v + np.bincount(row, v[col], n)
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        moved = np.bincount(r1, v[c1], n) - np.bincount(r2, v[c2], n)
        slope = np.bincount(col, error[row], d) + 2 * swap_weight * (np.bincount(c1, moved[r1], d) - np.bincount(c2, moved[r2], d))
        new = v - step * slope / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = bias_v - step * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    on = w != 0
    return Model(bias, kept[on], w[on])


def _scores(model: Model):
    """A function from batches of texts to batches of scores."""
    bias, features, weights = model.bias, model.features, model.weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = np.zeros(1 << BITS)
        weight[features] = weights
        used = weight != 0
        found = _Features()
        for texts in batches:
            z = []
            for a, b in slices(texts):
                f, rows = found.many(texts[a:b])
                row = np.repeat(np.arange(b - a), np.diff(rows))
                keys = [np.unique((row[hit] << BITS) | k[hit].astype(np.int64)) for k in f if (hit := used[k]).any()]
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                z.append(bias + np.bincount(keys >> BITS, weight[keys & ((1 << BITS) - 1)], b - a))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(z), -60, 60))) if z else np.zeros(0), pa.float64())

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts get the score of no features.  A null doc_id keeps its
    row (held_out false).  Repeated rows score alike; other columns are ignored.
    """
    scores = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                ids.append(batch.column(0))
                yield batch.column(1)

        for value in scores(texts()):
            yield pa.RecordBatch.from_arrays([ids.pop(), value], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose own text scores threshold or more, in one pass and without a join.

    Null and empty texts have the score of no features.  Each row is decided by
    its text alone, whatever its id and however often that repeats.
    """
    scored = F.arrow_udf(_scores(model), "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.filter(scored(null_to_empty()) < threshold)
