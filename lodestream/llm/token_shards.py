"""Token-ID output in training order.

Texts become sequences of seq_len token ids.  A keyed Feistel network over the
smallest even number of bits that covers N, walked until it lands below N, is
a permutation of 0..N-1: it gives every sequence its global slot without a
shuffle of keys or a sort.  Sequences are then range-partitioned by slot and
written as shards of fixed stride, so a reader finds slot s at byte
(s mod per_shard) x stride of shard s div per_shard and can resume anywhere.

Scale.  Sequences are numbered in the order of their documents' ids and texts,
by ranges, so slots depend on the documents, the key and seq_len alone: another
cluster, or another split of the input, writes the same shards and can go on
where the first one stopped.  Numbering sees some 40 bytes a document; token
ids are written once and shuffled twice, to meet their slot and into shards.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.bpe import codec_of, default_vocabulary
from lodestream.llm.common import materialise, mix, null_to_empty, numbered, slices

SEQ_LEN, PER_SHARD, KEY, ROUNDS = 512, 1024, 20240229, 6
PAD = 50256  # the end-of-text id
SHARD = "shard long, first_slot long, n_sequences int, stride int, doc_ids array<long>, lengths array<int>, payload binary, payload_sha256 string"


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0..n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & ((1 << 64) - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():  # cycle-walking
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, seq_len: int = SEQ_LEN, path: str | None = None) -> DataFrame:
    """task, place (where its document was cut), doc_id, digest of the text, n_seqs of the text, seq_no, n_tokens, tokens (little-endian unsigned 16-bit) of the whole texts."""
    path = path or default_vocabulary()
    names = ["task", "place", "doc_id", "digest", "n_seqs", "seq_no", "n_tokens", "tokens"]
    size = len(codec_of(path).vocabulary.length)
    if size > 1 << 16:
        raise ValueError(f"{path} has {size} ids; shards hold ids of 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, place = codec_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 21):
                docs_, digests, numbers, pieces, places, counts = [], [], [], [], [], []
                for doc, digest, ids in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), codec.encode_many(batch.column(2)[a:b].to_pylist())):
                    data = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    cut = range(0, len(data), 2 * seq_len)
                    docs_ += [doc] * len(cut)
                    digests += [digest] * len(cut)
                    places += [place] * len(cut)
                    counts += [len(cut)] * len(cut)
                    place += 1
                    numbers += range(len(cut))
                    pieces += [data[i : i + 2 * seq_len] for i in cut]
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(pieces), pa.int32()), pa.array(places, pa.int64()), pa.array(docs_, pa.int64()), pa.array(digests, pa.int64()), pa.array(counts, pa.int32()), pa.array(numbers, pa.int32()), pa.array([len(p) // 2 for p in pieces], pa.int32()), pa.array(pieces, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(null_to_empty()).alias("digest"), null_to_empty().alias("text"))
    return rows.mapInArrow(run, "task int, place long, doc_id long, digest long, n_seqs int, seq_no int, n_tokens int, tokens binary")


def slotted(docs: DataFrame, seq_len: int = SEQ_LEN, key: int = KEY, path: str | None = None) -> DataFrame:
    """The sequences with index (dense, by doc_id, text and seq_no) and slot (its permutation)."""
    rows = materialise(sequences(docs, seq_len, path), "sequences")
    n = rows.count()
    docs = rows.filter("seq_no = 0").select("doc_id", "digest", "task", "place", "n_seqs")
    before = numbered(docs, ["doc_id", "digest"], ["task", "place"], ["task", "place"], "n_seqs").drop("rank")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n, key))

    both = rows.join(before, ["task", "place"]).withColumn("index", F.col("index") + F.col("seq_no"))
    return both.withColumn("slot", slot("index")).select("index", "slot", "doc_id", "seq_no", "n_tokens", "tokens")


def shards(docs: DataFrame, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None) -> DataFrame:
    """One row for each shard, in slot order within range partitions.

    payload holds n_sequences records of stride bytes; a sequence shorter than
    seq_len is padded with the end-of-text id, and lengths says how many ids
    are its own.  Null and empty texts have no sequences.  Repeated rows have
    sequences of their own; a null doc_id keeps them.  Other columns are
    ignored.  A vocabulary with more than 65,536 ids is an error.
    """
    stride, pad = 2 * seq_len, np.array([PAD], "<u2").tobytes()
    rows = slotted(docs, seq_len, key, path).withColumn("shard", F.expr(f"slot div {per_shard}"))
    rows = rows.repartitionByRange("shard").sortWithinPartitions("slot").select("slot", "doc_id", "n_tokens", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, docs_, lengths, data = None, 0, [], [], []

        def done() -> pa.RecordBatch:
            payload = b"".join(data)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([first], pa.int64()), pa.array([len(docs_)], pa.int32()), pa.array([stride], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([payload], pa.binary()), pa.array([hashlib.sha256(payload).hexdigest()])], names)

        for batch in batches:
            for at, doc, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if at // per_shard != current:
                    if current is not None:
                        yield done()
                    current, first, docs_, lengths, data = at // per_shard, at, [], [], []
                docs_.append(doc)
                lengths.append(n)
                data.append(tokens + pad * (seq_len - n))
        if current is not None:
            yield done()

    names = ["shard", "first_slot", "n_sequences", "stride", "doc_ids", "lengths", "payload", "payload_sha256"]
    return rows.mapInArrow(run, SHARD)


def write(shards_: DataFrame, path: str) -> None:
    """Write shards as a table; each of its files covers a range of slots."""
    shards_.write.mode("overwrite").parquet(path)


def file_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def write_files(shards_: DataFrame, path: str) -> DataFrame:
    """Write each shard as a plain file of fixed-stride records under path, a folder or store that all executors reach.

    A file appears by a rename once it is whole, and holds the same bytes
    whoever writes it, so a task that is lost or runs twice leaves the same
    file.  Returns shard, first_slot, n_sequences, stride, doc_ids, lengths,
    payload_sha256, file: write it as the index of the files.
    """
    names = ["shard", "first_slot", "n_sequences", "stride", "doc_ids", "lengths", "payload_sha256", "file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                name = file_name(own.column("shard")[0].as_py())
                part = f"{base}/.{name}-{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(own.column("payload")[0].as_buffer())
                files.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:-1]), pa.array([f"{base}/{name}"])], names)

    kinds = dict(shards_.dtypes) | {"file": "string"}
    return shards_.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def read_records(path: str, slot: int, n: int, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of n records of write_files from a slot on, padding included: one seek a shard, then sequential reads."""
    files, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    stride = 2 * seq_len
    while n > 0:
        with files.open_input_file(f"{base}/{file_name(slot // per_shard)}") as f:
            f.seek(slot % per_shard * stride)
            while n > 0 and (data := f.read(stride)):
                yield np.frombuffer(data, "<u2")
                slot, n = slot + 1, n - 1
        if slot % per_shard:
            return  # the last shard ends here


def read_from(spark: SparkSession, path: str, slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, doc_id, n_tokens, tokens from a slot on, in slot order: shards before it are not read."""
    rows = spark.read.parquet(path).filter(F.col("shard") >= slot // per_shard)
    one = rows.select("first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("k", "d"))
    out = one.select((F.col("first_slot") + F.col("k")).alias("slot"), F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_tokens"), F.expr("substring(payload, k * stride + 1, 2 * d.lengths)").alias("tokens"))
    return out.filter(F.col("slot") >= slot).orderBy("slot")
