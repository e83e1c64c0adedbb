"""Document fingerprints by content-defined chunking.

Text is normalised (compatibility form, case folded, white space runs to one
space) and split where a gear hash of the last bytes has its top bits zero:
more of them before the mean chunk size and fewer after, between a least and a
largest size.  Boundaries depend on nearby content only, so they survive
shifts.  A fingerprint is the set of chunk digests with their lengths; the
likeness of two is the length of shared chunks over that of the lighter set.

The gear hash of a whole slice comes from five shift-and-add passes over its
bytes; only the boundaries are walked in Python.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from base64 import b64decode, b64encode
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import null_to_empty, slices, stream

LEAST, MEAN, MOST = 12, 32, 128  # bytes
DIGEST = 5  # bytes
_SPACE = re.compile(r"\s+")
_GEAR = (stream(256, 5) >> np.uint64(32)).astype(np.uint32)
_GEAR[255] = 0  # no byte of UTF-8: it stands between texts, so that no hash reaches over from one to the next
_BETWEEN = b"\xff" * 32
_STRICT = np.uint32(0xFFFFFFFF << (32 - MEAN.bit_length()) & 0xFFFFFFFF)  # one bit more than the mean asks for
_LOOSE = np.uint32(0xFFFFFFFF << (32 - MEAN.bit_length() + 2) & 0xFFFFFFFF)  # one bit less
BUCKET_ROWS = 2_000  # documents that are sorted together, about
MOST_BUCKETS = 20_000  # of which one row each is held on the driver


def normalise(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _SPACE.sub(" ", text.casefold()).strip()


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 32 bytes' values, each shifted by its age."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def boundaries(strict: list[int], loose: list[int], begin: int, end: int) -> list[int]:
    """Chunk ends of the bytes begin..end, from sorted candidate ends of both masks."""
    out, at = [], begin
    i = bisect_left(strict, begin)
    j = bisect_left(loose, begin)
    while at < end:
        low, mean, most = at + LEAST, at + MEAN, min(at + MOST, end)
        while i < len(strict) and strict[i] < low:
            i += 1
        if i < len(strict) and strict[i] <= min(mean, most):
            cut = strict[i]
        else:
            while j < len(loose) and loose[j] <= mean:
                j += 1
            cut = loose[j] if j < len(loose) and loose[j] < most else most
        out.append(cut)
        at = cut
    return out


def fingerprints(texts: list[str]) -> list[dict[bytes, int]]:
    """Digest to chunk length, for each text."""
    rows = [normalise(t).encode() for t in texts]
    data = np.frombuffer(b"".join(x for row in rows for x in (_BETWEEN, row)), np.uint8)
    if not len(data):
        return []
    h = gear(data)
    ends = np.flatnonzero((h & _LOOSE) == 0)
    strict = (ends[(h[ends] & _STRICT) == 0] + 1).tolist()
    loose = (ends + 1).tolist()
    out, at = [], 0
    for row in rows:
        at += len(_BETWEEN)
        found, last = {}, at
        for cut in boundaries(strict, loose, at, at + len(row)):
            piece = row[last - at : cut - at]
            found[hashlib.blake2b(piece, digest_size=DIGEST).digest()] = len(piece)
            last = cut
        out.append(found)
        at += len(row)
    return out


def to_string(found: dict[bytes, int]) -> str:
    """Eight base64 characters a chunk, digest and length, sorted: about a fifth of the text's size."""
    return "".join(sorted(b64encode(d + bytes([n])).decode() for d, n in found.items()))


def from_string(s: str) -> dict[bytes, int]:
    rows = (b64decode(s[i : i + 8]) for i in range(0, len(s), 8))
    return {x[:DIGEST]: x[DIGEST] for x in rows}


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Containment of the lighter in the other, by length; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row (doc_id, text); null and empty texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1), []
            for a, b in slices(texts):
                out += [to_string(f) for f in fingerprints(texts[a:b].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, ghost: each partition holds whole buckets of neighbouring rows, by descending id and by text.

    Buckets are ranges of ids between quantiles, so they are even for dense
    and for sparse ids alike; an id that fills several quantiles is dealt over
    as many buckets by quantiles of how its texts begin.  A bucket's last row
    is a ghost: a copy of the first row of the next bucket (after the last, of
    the first), so that every row's successor stands below it.  Texts are
    shuffled once; the driver sees one row a bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text"))
    # bitwise not turns the order around without overflow, so null ids come last; seven bytes of a text as a number keep its order
    begins = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = rows.withColumn("place", F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))))).withColumn("begins", begins)
    n = docs.count()
    parts = max(1, min(MOST_BUCKETS, n // bucket_rows))

    def quantiles(rows: DataFrame, column: str, parts: int) -> np.ndarray:
        shares = [k / parts for k in range(1, parts)]
        found = rows.agg(F.percentile_approx(column, shares, max(10_000, 4 * parts)).alias("q")).first().q if shares else None
        return np.array(found or [], np.int64)

    cuts = quantiles(rows, "place", parts)
    hot, times = np.unique(cuts, return_counts=True)
    inner = {int(p): quantiles(rows.filter(F.col("place") == int(p)), "begins", int(t) + 1) for p, t in zip(hot, times) if t > 1}

    @F.pandas_udf("int")
    def bucket(place: pd.Series, begins: pd.Series) -> pd.Series:
        out = cuts.searchsorted(place, "left")
        for p, inside in inner.items():
            at = (place == p).to_numpy()
            out[at] += inside.searchsorted(begins.to_numpy()[at], "left")
        return pd.Series(out.astype(np.int32))

    rows = rows.withColumn("b", bucket("place", "begins"))
    firsts = sorted((r.b, *r.f) for r in rows.groupBy("b").agg(F.min(F.struct("place", "begins")).alias("f")).collect())
    follow = [(b, *firsts[(k + 1) % len(firsts)][1:]) for k, (b, *_) in enumerate(firsts)]
    after = docs.sparkSession.createDataFrame(follow, "b int, place long, begins long")
    ghosts = rows.select("place", "begins", "text").join(F.broadcast(after), ["place", "begins"]).groupBy("b").agg(F.first("place").alias("place"), F.min("text").alias("text"))
    both = rows.select("b", "place", "doc_id", "text", F.lit(False).alias("ghost")).unionByName(ghosts.select("b", "place", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("ghost")))
    return both.repartition("b").sortWithinPartitions("b", "ghost", "place", "text").select("doc_id", "text", "ghost")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness.

    The edit replaces the last half of the code points by as many (or all) of
    the next document, by descending doc_id; after the last comes the first.
    Rows with equal doc_id follow each other by text, null ids come last; null
    texts are empty.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Other columns are ignored.
    """

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """rows: one more than are returned; ghosts return nothing."""
        texts = [t for _, t, _ in rows]
        own = fingerprints(texts)
        at = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edits = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
        edited = fingerprints(edits)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([rows[i][0] for i in at], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                "fingerprint": pa.array([to_string(own[i]) for i in at], pa.string()),
                "edited_fingerprint": pa.array([to_string(e) for e in edited], pa.string()),
                "near_edited": pa.array([likeness(own[i], e) for i, e in zip(at, edited)], pa.float64()),
                "near_next": pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows = held + list(zip(*(c.to_pylist() for c in part.columns)))
                held = rows[-1:]
                if len(rows) > 1:
                    yield compared(rows)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
