"""Byte-level BPE encoding and decoding.

Each short word is a contiguous array of part boundaries with the rank of every
adjacent pair beside it.  The smallest rank is found by a scan, its right
boundary deleted and the ranks of the two neighbours refreshed, until no pair
has a rank.  All new words of one length in a slice of texts are the rows of
one matrix, so each step is done for all of them at once; words that are not
short take a heap instead, as repeated scans would be quadratic there.  Words
repeat, so a task keeps the ids of words it has met in a table of bounded
size.  Documents are independent: no shuffle at all.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import null_to_empty, slices

#: How the byte-level pre-tokeniser splits text (public pattern of this vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts without characters past U+024F (letters and numbers spelt out), which the plain re module runs faster.
LATIN = r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+|\s+(?!\S)|\s+"
NOT_LATIN = re.compile("[^\x00-\x1b\x20-ɏ]")
CACHE_WORDS = 600_000  # about 200 bytes each
SHORT = 1024  # bytes of a word that is still scanned
SLOTS = 1 << 19
NONE = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        self.ids = ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        #: pairs of ids, left << 32 | right; and rank << 32 | merged id of each, so that the smallest value wins
        pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            pairs.setdefault(ids[left] << 32 | ids[right], rank << 32 | ids[left + right])
        self.merges = pairs
        # the pairs in a table of 2^19 slots; one whose slot is taken goes to the next free one
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.keys, self.values, slots = np.full(SLOTS, -1), np.full(SLOTS, NONE), self.slot(keys)
        while len(keys):
            slots, first = np.unique(slots, return_index=True)
            free = self.keys[slots] < 0
            self.keys[slots[free]], self.values[slots[free]] = keys[first[free]], values[first[free]]
            rest = np.ones(len(keys), bool)
            rest[first[free]] = False
            keys, values = keys[rest], values[rest]
            slots = self.slot(keys)
            while len(slots) and (taken := self.keys[slots] >= 0).any():
                slots[taken] = (slots[taken] + 1) % SLOTS
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        parts = ids | {}
        pieces = {i: b for b, i in parts.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(pieces) + 1
        lengths = np.array([len(pieces.get(i, b"")) for i in range(size)], np.int64)
        self.pool = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.length, self.offset = lengths, np.cumsum(lengths) - lengths
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.any, self.latin = regex.compile(SPLIT).findall, re.compile(LATIN).findall
        self.single = np.array(self.single, np.int64)
        one = np.arange(256)
        self.first = self.ranks(self.single[np.repeat(one, 256)], self.single[np.tile(one, 256)]).reshape(256, 256)

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        return self.any(text) if NOT_LATIN.search(text) else self.latin(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of each pair of ids, NONE without a merge."""
        key = left << 32 | right
        at = self.slot(key)
        found = self.keys[at]
        value = np.where(found == key, self.values[at], NONE)
        left = np.flatnonzero((found != key) & (found >= 0))
        while left.size:
            at[left] = (at[left] + 1) % SLOTS
            found = self.keys[at[left]]
            same = found == key[left]
            value[left[same]] = self.values[at[left[same]]]
            left = left[~same & (found >= 0)]
        return value

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x1E3779B97F4A7C15)) >> 40) & (SLOTS - 1)

    def parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes of words (a matrix, one word a row), and the ranks of the pairs."""
        return self.single[words], self.first[words[:, :-1], words[:, 1:]]

    def short(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """words: a matrix of bytes, one word a row.  Pairs (row numbers, matrix of their ids)."""
        row, done = np.arange(len(words)), []
        part, rank = self.parts(words)
        while rank.shape[1]:
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(row)), best]
            ended = value == NONE
            if ended.any():
                done.append((row[ended], part[ended]))
                live = ~ended
                row, part, rank, best, value = row[live], part[live], rank[live], best[live], value[live]
            n, width = rank.shape
            if not n:
                return done
            i = np.arange(n)
            kept = np.ones(part.shape, bool)
            kept[i, best + 1] = False  # the boundary between the two parts goes
            part[i, best] = value & 0xFFFFFFFF
            part = part[kept].reshape(n, width)
            kept = np.ones(rank.shape, bool)
            kept[i, best] = False
            rank = rank[kept].reshape(n, width - 1)
            j = np.flatnonzero(best < width - 1)
            rank[j, best[j]] = self.ranks(part[j, best[j]], part[j, best[j] + 1])
            j = np.flatnonzero(best > 0)
            rank[j, best[j] - 1] = self.ranks(part[j, best[j] - 1], part[j, best[j]])
        done.append((row, part))
        return done

    def long(self, data: bytes) -> list[int]:
        """The same ids for one long word, from a heap of pairs."""
        part, get = self.parts(np.frombuffer(data, np.uint8)[None])[0][0].tolist(), self.merges.get
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(value >> 32, i, value & 0xFFFFFFFF, part[i], part[i + 1]) for i in range(n - 1) if (value := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (value := get(part[x] << 32 | part[y])) is not None:
                    heapq.heappush(heap, (value >> 32, x, value & 0xFFFFFFFF, part[x], part[y]))
        return [p for p in part if p >= 0]


class Codec:
    """Encodes and decodes texts; keeps the ids of up to `limit` words (and the new ones of one slice)."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.vocabulary, self.limit = Vocabulary(path), limit
        self.words: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        known, by_length = self.words, defaultdict(list)
        for word in words:
            by_length[len(word) if word.isascii() else -1].append(word)
        for word in by_length.pop(-1, ()):
            by_length[len(word.encode())].append(word)
        for length, found in by_length.items():
            if length > SHORT:
                known.update((word, np.array(self.vocabulary.long(word.encode()), "<u4").tobytes()) for word in found)
                continue
            for a in range(0, len(found), 1 << 13):
                some = found[a : a + (1 << 13)]
                matrix = np.frombuffer("".join(some).encode(), np.uint8).reshape(len(some), length)
                for rows, ids in self.vocabulary.short(matrix):
                    whole = np.ascontiguousarray(ids, "<u4").view(np.dtype((np.void, 4 * ids.shape[1])))[:, 0]
                    known.update(zip(map(some.__getitem__, rows.tolist()), whole.tolist()))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit; special strings become their own ids."""
        v = self.vocabulary
        split = []
        for text in texts:
            if v.cut is None or not any(s in text for s in v.special):
                split.append(v.find(text))
            else:
                split.append(list(chain.from_iterable([x] if x in v.special else v.find(x) for x in v.cut.split(text) if x)))
        if len(self.words) > self.limit:
            self.words.clear()
        self.words.update((s, np.array([i], "<u4").tobytes()) for s, i in v.special.items())
        self._learn(set(chain.from_iterable(split)).difference(self.words))
        of = self.words.__getitem__
        return [b"".join(map(of, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids' pieces; unknown ids have none."""
        v = self.vocabulary
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        i = i[i < len(v.length)]
        lengths = v.length[i]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        where = np.arange(ends[-1]) + np.repeat(v.offset[i] - (ends - lengths), lengths)
        return v.pool[where].tobytes()


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The codec of a Python worker: the vocabulary is read once and its words are kept between tasks."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text), and ids binary (little-endian unsigned 32-bit), for each row.

    Null and empty texts have no ids.  Every row gives one row; no column but
    the text matters.
    """
    path = path or default_vocabulary()
    names = keep if keep is not None else [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*names, null_to_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = batch.column(len(names))
            for a, b in slices(texts, 1 << 21):
                ids = codec.encode_many(texts[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), pa.array(ids, pa.binary())], [*names, "ids"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "ids binary"]))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """rows with text_bytes binary, the decoded bytes of `ids` (null: none), UTF-8 where the ids came from text."""
    path = path or default_vocabulary()
    names = [c for c in rows.columns if c != "text_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([codec.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())], [*names, "text_bytes"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields]
    return rows.select(*names).mapInArrow(run, ", ".join([*fields, "text_bytes binary"]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, then decoded from its ids.

    Both directions run in one pass over a document, so ids never leave the
    task unless they are asked for.  Bytes that are no UTF-8 decode to U+FFFD.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts, n, ids_sha, text_sha = batch.column(1), [], [], []
            for a, b in slices(texts, 1 << 21):
                for ids in codec.encode_many(texts[a:b].to_pylist()):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
