"""Bounded-space online packing of tokenised documents into sequences.

Documents come in an order fixed by their ids and texts and are dealt into
lanes of LANE_DOCS.  A lane keeps OPEN windows: a document goes to the window
that it fills best; where none fits, the fullest is emitted, topped up by the
head of the document unless the gap is smaller than LEAST_CUT tokens.  What the
lanes leave open is packed again, FAN lanes at a time, until one lane is left;
the last leftovers are merged end to end, and what then is left over is dealt
into sequences of powers of two, which need no padding.

Scale.  Packing sees lengths only: some 30 bytes a document go through the
lanes, while ids are written once and shuffled once, to be cut where the plan
says.  A lane holds OPEN windows and no more, whatever the corpus size.  The
result depends on the documents, not on files, cores or partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import materialise, null_to_empty, numbered, slices
from lodestream.llm.word_bpe import codec_of, default_vocabulary, halves, pieces

BUDGET, OPEN, LEAST_CUT, LANE_DOCS, FAN, END = 4096, 32, 16, 4096, 64, 2
_LANE_BITS, _NUMBER_BITS = 30, 30


def tokenised(docs: DataFrame, end: int = END, path: str | None = None) -> DataFrame:
    """task, place (the row's key), doc_id, digest of the text, n ids with the end id, ids (little-endian unsigned 16-bit), as a written table."""
    path = path or default_vocabulary()
    names = ["task", "place", "doc_id", "digest", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, place, last = codec_of(path), TaskContext.get().partitionId(), 0, np.array([end], "<u2").tobytes()
        if len(codec.vocabulary.length) > 1 << 16:
            raise ValueError(f"{path} has more than 65,536 ids")
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 21):
                ids = [halves(x) + last for x in codec.encode_many(batch.column(2)[a:b].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, task, np.int32)), pa.array(np.arange(place, place + b - a)), batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names)
                place += b - a

    text = null_to_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return materialise(rows.mapInArrow(run, "task int, place long, doc_id long, digest long, n long, ids binary"), "tokenised")


class Lane:
    """The open windows of one lane; items are (task, place), start and length."""

    def __init__(self, budget: int, limit: int, least: int):
        self.budget, self.limit, self.least = budget, limit, least
        self.windows: list[tuple[int, int, list]] = []  # gap, when it was opened, pieces: sorted
        self.opened = 0

    def add(self, item: tuple, start: int, length: int) -> Iterator[list]:
        """Place an item; yields the sequences that this closes."""
        while length >= self.budget:
            yield [(*item, start, self.budget)]
            start, length = start + self.budget, length - self.budget
        while length:
            at = bisect_left(self.windows, (length,))
            if at < len(self.windows):  # the smallest gap that is large enough
                gap, age, own = self.windows.pop(at)
                own.append((*item, start, length))
                if gap == length:
                    yield own
                else:
                    insort(self.windows, (gap - length, age, own))
                return
            if len(self.windows) < self.limit:
                insort(self.windows, (self.budget - length, self.opened, [(*item, start, length)]))
                self.opened += 1
                return
            gap, _, own = self.windows.pop(0)
            if gap >= self.least:
                own.append((*item, start, gap))
                start, length = start + gap, length - gap
            yield own

    def left(self) -> list[list]:
        return [own for _, _, own in self.windows]

    def merged(self) -> Iterator[list]:
        """The open windows end to end, cut at the budget; the rest by powers of two."""
        room, own = self.budget, []
        total = sum(p[-1] for w in self.left() for p in w)
        rest = total % self.budget
        sizes = [self.budget] * (total // self.budget) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        sizes = iter(sizes)
        room = next(sizes, 0)
        for *item, start, length in (p for w in self.left() for p in w):
            while length:
                take = min(room, length)
                own.append((*item, start, take))
                start, length, room = start + take, length - take, room - take
                if not room:
                    yield own
                    own, room = [], next(sizes, 0)


def _level(items: DataFrame, level: int, final: bool, budget: int, limit: int, least: int) -> DataFrame:
    """items (lane, at..., task, place, start, length) sorted by lane: sequence_id, offset, task, place, start, length; or lane and window of what stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, here, number, out = None, None, 0, []

        def close(own: list, window: int | None = None) -> None:
            nonlocal number
            if number >> _NUMBER_BITS:
                raise ValueError("a lane has too many sequences to number")
            offset, name = 0, level << (_LANE_BITS + _NUMBER_BITS) | here << _NUMBER_BITS | number
            for task, place, start, length in own:
                out.append((here, window, None if window is not None else name, offset, task, place, start, length))
                offset += length
            number += window is None

        def done() -> None:
            if lane is not None:
                if final:
                    for own in lane.merged():
                        close(own)
                else:
                    for k, own in enumerate(lane.left()):
                        close(own, k)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != here:
                    done()
                    here, number, lane = row[0], 0, Lane(budget, limit, least)
                for own in lane.add(row[1:3], row[3], row[4]):
                    close(own)
                if len(out) >= 4096:
                    yield flush()
        done()
        if out:
            yield flush()

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["lane", "window", "sequence_id", "offset", "task", "place", "start", "length"]
    order = [c for c in ("from_lane", "window", "offset", "index") if c in items.columns]
    dealt = items.repartition("lane").sortWithinPartitions("lane", *order).select("lane", "task", "place", "start", "length")
    return materialise(dealt.mapInArrow(run, "lane long, window long, sequence_id long, offset long, task int, place long, start long, length long"), f"packed-{level}")


def plan(lengths: DataFrame, n_rows: int, budget: int = BUDGET, open_windows: int = OPEN, least_cut: int = LEAST_CUT, lane_docs: int = LANE_DOCS, fan: int = FAN) -> DataFrame:
    """task, place, start, length, sequence_id, offset of every piece, from index, task, place, n of every document."""
    lanes, level = max(1, -(-n_rows // lane_docs)), 0
    items = lengths.select(F.expr(f"index div {lane_docs}").alias("lane"), "index", "task", "place", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"))
    closed = None
    while True:
        done = _level(items, level, lanes == 1, budget, open_windows, least_cut)
        own = done.filter("sequence_id is not null").select("task", "place", "start", "length", "sequence_id", "offset")
        closed = own if closed is None else closed.unionByName(own)
        if lanes == 1:
            return closed
        left = done.filter("sequence_id is null")
        items = left.select(F.expr(f"lane div {fan}").alias("lane"), F.col("lane").alias("from_lane"), "window", "offset", "task", "place", "start", "length")
        lanes, level = -(-lanes // fan), level + 1


def pack(docs: DataFrame, budget: int = BUDGET, open_windows: int = OPEN, least_cut: int = LEAST_CUT, lane_docs: int = LANE_DOCS, fan: int = FAN, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids of every piece: ids are little-endian unsigned 32-bit.

    A null or empty text is its end id alone.  Rows that repeat an id are
    documents of their own, and rows without one too.  Rows equal in id and text
    are interchangeable.  Other columns are ignored; an empty table has no
    pieces.  A budget below one is an error.
    """
    if budget < 1 or open_windows < 1:
        raise ValueError("a window holds at least one token, and one window is open")
    rows = tokenised(docs, end, path)
    order = numbered(rows.select("doc_id", "n", "digest", "task", "place"), ["doc_id", "n", "digest"], ["task", "place"], ["task", "place", "n"])
    cuts = plan(order, rows.count(), budget, open_windows, least_cut, lane_docs, fan)
    own = cuts.groupBy("task", "place").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    both = rows.join(own, ["task", "place"]).select("doc_id", "n", "ids", "cuts")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                out: list[tuple] = []
                for doc, n, ids, own in zip(*(c[a:b].to_pylist() for c in batch.columns)):
                    some = sorted((c["start"], c["length"], c["sequence_id"], c["offset"]) for c in own)
                    out += [(doc, s, k, n, seq, at, data) for (s, k, seq, at), data in zip(some, pieces(ids, ((s, k) for s, k, _, _ in some)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [*[pa.int64()] * 6, pa.binary()])], names)

    return both.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, budget: int = BUDGET, pad: int = END) -> DataFrame:
    """sequence_id, length, doc_ids, starts (where each piece begins) and ids, padded to budget unless the length is a power of two."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("own"))
    whole = F.aggregate("own", F.lit(b""), lambda made, piece: F.concat(made, piece.ids))
    full = F.rpad(whole, 4 * budget, F.lit(int(pad).to_bytes(4, "little")))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    return own.select("sequence_id", "length", F.transform("own", lambda p: p.doc_id).alias("doc_ids"), F.transform("own", lambda p: p.offset).alias("starts"), F.when(power, whole).otherwise(full).alias("ids"))
