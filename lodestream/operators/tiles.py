"""Queries against all items, tile by tile: dense scores in tasks, of which each tile hands on only what can still count.

Both sides are dealt by hashes of their ids.  A task holds one block of queries
and one tile of items and scores a few queries at a time as one matrix, so no
row stands for a pair of query and item that nobody asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384  # queries in a block
ITEM_ROWS = 40_000  # items in a tile
CELLS = 2_000_000  # scores of a matrix
CHUNK = 8_192  # items looked at together for the nearest
PAIRS = 65_536  # scored together
NONE = np.iinfo(np.int64).min  # the key of what stands in no list


def tiled(queries: DataFrame, items: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """work(queries of a block, items of a tile) for every block and tile; queries carry query_id, items item_id."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    n = items.count()
    items = items.select(*(F.col(c).alias(c) for c in items.columns))  # its own columns, also where both sides come from one table
    blocks, tiles = max(1, -(-queries.count() // block_rows)), max(1, -(-n // item_rows), min(2 * cores, -(-n // 1_000)))
    of = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    parts = min(blocks * tiles, max(200, 4 * cores))
    q = queries.withColumn("__block", of("query_id", blocks)).select("*", each(tiles).alias("__tile")).repartition(parts, "__block", "__tile")
    i = items.withColumn("__tile", of("item_id", tiles)).select("*", each(blocks).alias("__block")).repartition(parts, "__block", "__tile")
    return q.groupBy("__block", "__tile").cogroup(i.groupBy("__block", "__tile")).applyInArrow(work, schema)


def steps(x: np.ndarray, digits: int) -> np.ndarray:
    """x in whole steps of the last of so many decimals, as `numbers.rounded` takes them: by the exact value, half to even."""
    scale = 10.0**digits
    product = x * scale
    out = np.rint(product)
    product -= out
    unsure = np.flatnonzero(np.abs(product, out=product).ravel() > 0.5 - 1e-5)  # beyond the error of the product
    if unsure.size:
        flat, values = out.reshape(-1), x.reshape(-1)[unsure].tolist()
        flat[unsure] = [float((Decimal(v) * 10**digits).to_integral_value(ROUND_HALF_EVEN)) for v in values]
        out = flat.reshape(x.shape)
    return out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, scaled to length 1; those without length stay 0."""
    flat = column.combine_chunks()
    made = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1 if len(flat) else 0)
    length = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return np.divide(made, length, out=np.zeros_like(made), where=length > 0)


def best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest keys of each row, in no order, without those that are NONE."""
    n = keys.shape[1]
    at = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), keys.shape)
    row, column = np.repeat(np.arange(len(keys)), at.shape[1]), at.ravel()
    there = keys[row, column] != NONE
    return row[there], column[there]


def contenders(scores: np.ndarray, k: int, slack: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all that is finite and at most `slack` below the k-th largest of its row."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] - slack if k < n else np.full(len(scores), -np.inf)
    return np.nonzero((scores >= least[:, None]) & (scores > -np.inf))


def first(row: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest keys of each row are; rows ascend."""
    order = np.lexsort((-keys, row))
    starts = np.searchsorted(row, row[order])
    return order[np.arange(len(row)) - starts < k]


def runs(n_queries: int, n_items: int) -> Iterator[slice]:
    size = max(1, CELLS // max(1, n_items))
    return (slice(k, min(k + size, n_queries)) for k in range(0, n_queries, size))


def nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Work of a tile: the k items most similar to each query, of equal ones those of lowest id.

    Items come by id, a chunk after another.  Single precision tells which of
    them may still be among the best k, by the bound of its error, and only
    those are scored; where a chunk has many of them (copies of one vector), all of it is.
    """

    def work(queries: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("item_id")
        ids, asked = items["item_id"].to_numpy(), queries["query_id"].to_numpy()
        found = []
        if len(ids) and len(asked):
            qs, vs, n = matrix(queries["embedding"]), matrix(items["embedding"]), len(ids)
            rough_qs, rough_vs = qs.astype(np.float32), vs.astype(np.float32)
            margin = (qs.shape[1] + 16) * 2.0**-24  # of a product of two vectors of length 1
            key = lambda near, at: near.astype(np.int64) * (n + 1) - at
            for run in runs(len(asked), min(n, CHUNK)):
                own, m = asked[run], run.stop - run.start
                kept, least = np.full((m, k), NONE), np.full(m, -np.inf, np.float32)
                for begin in range(0, n, CHUNK):
                    chunk = slice(begin, min(begin + CHUNK, n))
                    at = np.arange(chunk.start, chunk.stop)
                    hit = np.flatnonzero(rough_qs[run] @ rough_vs[chunk].T >= least[:, None]) if begin else None
                    if hit is None or hit.size > m * len(at) // 16:
                        keys = np.where(ids[chunk] == own[:, None], NONE, key(steps(qs[run] @ vs[chunk].T, 6), at))
                        row, column = best(keys, k)
                        new = keys[row, column]
                    else:
                        row, column = np.divmod(hit, len(at))
                        other = ids[column + begin] != own[row]
                        row, column = row[other], column[other] + begin
                        parts = [np.einsum("ij,ij->i", qs[run][row[j : j + PAIRS]], vs[column[j : j + PAIRS]]) for j in range(0, len(row), PAIRS)]
                        new = key(steps(np.concatenate(parts), 6), column) if parts else np.zeros(0, np.int64)
                    if len(new):
                        kept = _largest(kept, row, new)
                        # later items have higher ids: they have to be more similar by a whole step
                        least = np.where(kept[:, 0] == NONE, -np.inf, (-(-kept[:, 0] // (n + 1)) + 0.5) / 1e6 - margin).astype(np.float32)
                row, column = np.nonzero(kept != NONE)
                near, at = (x := -(-kept[row, column] // (n + 1))), x * (n + 1) - kept[row, column]
                found.append((own[row], ids[at], near / 1e6))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["query_id", "item_id", "similarity"])

    return work


def _largest(kept: np.ndarray, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The largest of the keys kept of each row and the new ones, as many as before, in ascending order."""
    m, k = kept.shape
    rows, every = np.concatenate([np.repeat(np.arange(m), k), row]), np.concatenate([kept.ravel(), keys])
    order = np.lexsort((every, rows))
    ends = np.cumsum(np.bincount(rows, minlength=m))
    return every[order][ends[:, None] - np.arange(k, 0, -1)]
