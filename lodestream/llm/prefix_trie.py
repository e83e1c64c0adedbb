"""Prefix trie of conversations, from their sorted order.

Conversations are sorted by their turns, and the trie is read off the array of
longest common prefixes (LCP) of neighbours: the Cartesian tree over that
array, with nodes of equal LCP merged, has the trie's branching nodes, each an
interval of the order.  Its edges are expanded to the depths they skip, and
what a node reports is an aggregate of its interval.

* `ordered` numbers the conversations.  Turns are compared by 128-bit digests,
  SEGMENT of them at a time: segments are ranked, then ranks of two, four, ...
  segments, so a conversation of any length is one number in the end, after
  as many rounds as its number of segments has binary digits.
* `intervals` finds each entry's nearest smaller values.  Blocks of BLOCK
  entries are independent: a stack answers most of them.  The rest, one row a
  block for each value still open, look for the first block whose minimum is
  smaller, and there for the place on the block's staircase of running minima.
* Sums over an interval are differences of prefix sums; the smallest member is
  a range minimum: inside a block from a sparse table, across blocks from the
  blocks' ends and minima.

Scale.  No conversation, interval or common prefix is held by one task: ranges
number turns, rows of a node meet only where they are expanded, SEGMENT depths
at a time.  Four numbers a block (one block is 16,384 conversations) go through
the driver.  The one exception is the digest of the ids that end at a node,
which the result asks for: one running hash reads them in order, in constant
memory but in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.chat_format import prefix_sums
from lodestream.llm.common import materialise, numbered

SEGMENT, BLOCK = 256, 16384
SHARE, HEADS = 5, 9  # conversations that take turns from one another, and the modulus of how many
NO_IDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, share: int = SHARE, heads: int = HEADS, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, low, cum) of every turn, and (c, n) of every conversation, after heads are exchanged.

    Conversation c begins with the first h turns of c - c % share, h being
    crc32(c) % heads, and goes on with its own after the first h.  key is the
    turn's digest, low and cum the UTF-8 bytes of the texts before it and up to
    its end.
    """
    rows = prefix_sums(turns.filter("conv_id is not null"), F.octet_length("text"))
    turn = F.concat(F.lpad(F.octet_length("role").cast("string"), 10, "0"), "role", "text")
    key = F.substring(F.unhex(F.sha2(turn, 256)), 1, 16)
    rows = materialise(rows.select(F.col("conv_id").alias("c"), F.col("position").alias("pos"), key.alias("key"), F.col("before").alias("low"), (F.col("before") + F.col("tokens")).alias("cum")), "trie-turns")
    # the first heads - 1 turns of a conversation are the most that another takes or that it leaves out
    first = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.when(F.col("pos") < heads - 1, F.struct("pos", "key", "low", "cum")))).alias("head"), F.count(F.lit(1)).alias("own"))
    h, zero = F.expr(f"crc32(cast(c as string)) % {heads}"), F.lit(0).cast("long")
    talks = first.select("c", (F.col("c") - F.col("c") % share).alias("base"), h.alias("h"), "own", F.coalesce(F.try_element_at(F.slice("head.cum", F.lit(1), h.cast("int")), F.lit(-1)), zero).alias("skipped"))
    taken = talks.join(first.select(F.col("c").alias("base"), "head"), "base", "left")
    taken = taken.select("c", "h", "own", "skipped", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("head"))
    n = F.greatest(zero, F.size("head").cast("long"))
    taken = materialise(taken.withColumns({"taken": n, "given": F.coalesce(F.try_element_at(F.col("head.cum"), F.lit(-1)), zero)}), "trie-heads")
    begins = taken.select("c", F.explode("head").alias("t")).select("c", "t.*")
    # a long conversation meets its row of `taken` a segment at a time
    cut = taken.filter("own > h").select("c", F.explode(F.expr(f"sequence(h div {segment}, (own - 1) div {segment})")).alias("s"), "h", "skipped", "given", "taken")
    rest = rows.withColumn("s", F.expr(f"pos div {segment}")).join(cut, ["c", "s"]).filter("pos >= h")
    moved = F.col("given") - F.col("skipped")
    goes_on = rest.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", (F.col("low") + moved).alias("low"), (F.col("cum") + moved).alias("cum"))
    talks = taken.select("c", (F.col("taken") + F.greatest(zero, F.col("own") - F.col("h"))).alias("n"))
    return materialise(begins.unionByName(goes_on), "trie-rebuilt"), materialise(talks, "trie-conversations")


def ordered(rows: DataFrame, talks: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(i, c, n, rank) of every conversation in the order of its turns, and the segments (c, s, keys) of its digests."""
    s = F.expr(f"pos div {segment}")
    segments = materialise(rows.groupBy("c", s.alias("s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda x: x.key).alias("keys")), "trie-segments")
    most = segments.agg(F.max("s")).first()[0] or 0
    if not most:  # one segment each: the digests themselves are the order
        whole = materialise(talks.join(segments.select("c", "keys"), "c", "left"), "trie-whole")
        return numbered(whole, ["keys"], ["c"], ["c", "n"]).withColumnRenamed("index", "i"), segments
    level = numbered(segments, ["keys"], ["c", "s"], ["c", "s"]).select("c", "s", F.col("rank").alias("r"))
    while most:
        pairs = level.groupBy("c", F.expr("s div 2").alias("s")).agg(F.max(F.when(F.col("s") % 2 == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("s") % 2 == 1, F.col("r"))).alias("b"))
        most //= 2
        if most:
            level = numbered(materialise(pairs, "trie-pairs"), ["a", "b"], ["c", "s"], ["c", "s"]).select("c", "s", F.col("rank").alias("r"))
    whole = materialise(talks.join(pairs.select("c", "a", "b"), "c", "left"), "trie-whole")
    return numbered(whole, ["a", "b"], ["c"], ["c", "n"]).withColumnRenamed("index", "i"), segments


def common_prefixes(order: DataFrame, segments: DataFrame, rows: DataFrame, segment: int) -> DataFrame:
    """i, c, n, rank, lcp (turns shared with conversation i - 1, -1 for the first), after (lcp of i + 1, -1 for the last), shared (bytes of those turns)."""
    before = order.select((F.col("i") + 1).alias("i"), F.col("c").alias("p"), F.col("n").alias("np"), F.col("rank").alias("rp"))
    pairs = materialise(order.join(before, "i", "left"), "trie-neighbours")
    differ = pairs.filter("p is not null and rank <> rp")
    both = differ.filter("least(n, np) > 0").select("i", "c", "p", F.explode(F.expr(f"sequence(0L, (least(n, np) - 1) div {segment})")).alias("s"))
    left = both.select("i", "c", "s").join(segments, ["c", "s"]).select("i", "s", "keys")
    right = both.select("i", F.col("p").alias("c"), "s").join(segments, ["c", "s"]).select("i", "s", F.col("keys").alias("other"))
    at = F.array_position(F.zip_with("keys", "other", lambda x, y: x.eqNullSafe(y)), F.lit(False))  # from 1, 0 if they are equal
    first = left.join(right, ["i", "s"]).filter(at > 0).groupBy("i").agg(F.min(F.col("s") * segment + at - 1).alias("at"))
    found = pairs.join(first, "i", "left")
    lcp = F.when(F.col("p").isNull(), F.lit(-1)).when(F.col("rank") == F.col("rp"), F.col("n")).otherwise(F.coalesce("at", F.least("n", "np"))).cast("long")
    found = materialise(found.select("i", "c", "n", "rank", lcp.alias("lcp")), "trie-lcp")
    ends = found.filter("lcp > 0").select("i", "c", (F.col("lcp") - 1).alias("pos"))
    shared = ends.join(rows.select("c", "pos", "cum"), ["c", "pos"]).select("i", F.col("cum").alias("shared"))
    after = found.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("after"))
    both = found.join(shared, "i", "left").join(after, "i", "left")
    return both.withColumns({"shared": F.coalesce("shared", F.lit(0).cast("long")), "after": F.coalesce("after", F.lit(-1).cast("long"))})


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest strictly smaller values before and after each value; -1 and len(values) where there is none."""
    n = len(values)
    left, right, stack = np.full(n, -1), np.full(n, n), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = i
        # below equal values lies the one that is smaller than both
        left[i] = -1 if not stack else left[stack[-1][0]] if stack[-1][1] == v else stack[-1][0]
        stack.append((i, v))
    return left, right


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: row k holds the minimum of 2^k values from each place on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    return table


def least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of each non-empty range low..high, both ends in it."""
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(table[level][low[own]], table[level][high[own] + 1 - (1 << level)])
    return out


_PART = "kind string, block long, v long, side string, n long, p long, pblock long, pv long, pside string, size long, least long, parent long, bytes long, leaves long, kids long, ends boolean, i long, c long, lb long, rb long"
_NODE = ["i", "c", "p", "v", "pblock", "pv", "pside", "size", "least", "parent", "bytes", "leaves", "kids", "ends"]


def blocks_of(lcp: DataFrame, block: int) -> DataFrame:
    """What each block of the LCP array says alone, one row of one kind each:

    inner: an interval inside the block, complete but for its parent where that is no inner one;
    own: a conversation whose last turns it shares with none;
    open: a value whose interval reaches over the block's start (side L) or, beginning in it, over its end (side R);
    head, tail: the staircases of running minima from the block's start and to its end, with what lies before or from there on;
    block: its minimum, smallest id and sums.
    """
    rows = lcp.withColumn("block", F.expr(f"i div {block}"))
    rows = rows.repartition("block").sortWithinPartitions("block", "i").select("block", "i", "c", "n", "lcp", "after", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def fill(kind: str, rows: int, /, **columns) -> pa.RecordBatch:
            columns |= {"kind": [kind] * rows, "block": [current] * rows}
            made = [columns.get(f.name, [None] * rows) for f in schema]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            i, c, n, v, after, shared = (np.asarray(whole.column(k).combine_chunks()) for k in range(1, 7))
            b, m, base = current, len(i), i[0]
            left, right = smaller(v)
            ids, sums, leaf = minima(c), np.concatenate([[0], np.cumsum(shared)]), after < n
            leaves, same = np.concatenate([[0], np.cumsum(leaf)]), (v == n) & (i > 0)  # same: equal to the one before
            side = np.where(left < 0, "L", np.where(right >= m, "R", ""))
            inner = (left >= 0) & (right < m)
            # inner intervals, each from its entries: key (left end, value)
            at = np.flatnonzero(inner)
            smallest = np.full(m, -1, np.int64)  # of the interval of each inner entry
            if len(at):
                smallest[at] = least(ids, left[at], right[at] - 1)
            order = at[np.lexsort((at, v[at], left[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (left[order[1:]] != left[order[:-1]]) | (v[order[1:]] != v[order[:-1]])
            one = order[new]
            kids = np.add.reduceat((~same[order]).astype(np.int64), np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)

            def parents(low: np.ndarray, high: np.ndarray, high_v: np.ndarray) -> dict:
                """The enclosing interval, by the larger of the values at both ends: its smallest id, or where it is to be looked up."""
                by_low = v[low] >= high_v
                p, at = np.maximum(v[low], high_v), np.where(by_low, low, np.minimum(high, m - 1))
                out = ~by_low & (high >= m)  # the next block's first entry
                known = ~out & inner[at] & (p >= 0)
                lookup = ~known & (p >= 0)
                return {
                    "p": p, "parent": pa.array(smallest[at], pa.int64(), mask=~known), "pblock": pa.array(np.where(out, b + 1, b), pa.int64(), mask=~lookup),
                    "pv": pa.array(p, pa.int64(), mask=~lookup), "pside": pa.array(np.where(out, "L", side[at]).tolist(), pa.string(), mask=~lookup),
                }

            if len(one):
                low, high = left[one], right[one]
                yield fill("inner", len(one), v=v[one], i=base + low, c=c[low], size=high - low, least=smallest[one], bytes=sums[high] - sums[low + 1], leaves=leaves[high] - leaves[low], kids=kids + (n[low] > v[one]), ends=n[low] == v[one], **parents(low, high, v[high]))
            own = np.flatnonzero(n > np.maximum(v, after))
            if len(own):
                yield fill("own", len(own), v=n[own], i=i[own], c=c[own], size=np.ones(len(own), np.int64), least=c[own], bytes=np.zeros(len(own), np.int64), leaves=np.ones(len(own), np.int64), kids=np.zeros(len(own), np.int64), ends=np.ones(len(own), bool), **parents(own, own + 1, after[own]))
            # values whose intervals go on elsewhere
            for s in "LR":
                at = np.flatnonzero((side == s) & (v >= 0))
                if len(at):
                    order = at[np.argsort(v[at], kind="stable")]
                    new = np.concatenate([[True], v[order[1:]] != v[order[:-1]]])
                    one = order[new]
                    count = np.add.reduceat((~same[order]).astype(np.int64), np.flatnonzero(new))
                    # the right end may lie in the block although the left one does not: of the last entry with the value
                    last = order[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(order) - 1]])]
                    yield fill("open", len(one), v=v[one], side=[s] * len(one), kids=count, lb=pa.array(np.full(len(one), b), pa.int64(), mask=np.full(len(one), s == "L")), rb=pa.array(np.full(len(one), b), pa.int64(), mask=right[last] >= m))
            # staircases; the first of equal values from the start, the last of them to the end
            head = np.flatnonzero(np.concatenate([[True], v[1:] < np.minimum.accumulate(v)[:-1]]))
            tail = m - 1 - np.flatnonzero(np.concatenate([[True], v[::-1][1:] < np.minimum.accumulate(v[::-1])[:-1]]))
            before = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(c)])
            rest = np.minimum.accumulate(c[::-1])[::-1]
            yield fill("head", len(head), v=v[head], i=i[head], size=head, least=before[head], bytes=sums[head], leaves=leaves[head], side=side[head].tolist())
            yield fill("tail", len(tail), v=v[tail], i=i[tail], size=m - tail, least=rest[tail], bytes=sums[m] - sums[tail + 1], leaves=leaves[m] - leaves[tail], side=side[tail].tolist(), n=n[tail], c=c[tail])
            yield fill("block", 1, v=[int(v.min())], size=[m], least=[int(c.min())], bytes=[int(sums[m])], leaves=[int(leaves[m])])

        for batch in batches:
            keys = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if current is not None and keys[a] != current:
                    yield from done()
                    held = []
                current = int(keys[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield from done()

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _PART.split(", ")])
    return materialise(rows.mapInArrow(run, _PART), "trie-blocks")


def nearest(table: list[np.ndarray], at: np.ndarray, v: np.ndarray, back: bool) -> np.ndarray:
    """The last place before, or the first place after, each of `at` whose value is below v (-1 or the length if there is none)."""
    n = len(table[0])
    at = at.copy() if back else at + 1
    for k in reversed(range(len(table))):
        step = 1 << k
        start = at - step if back else at
        fits = (start >= 0) & (start + step <= n)
        fits[fits] = table[k][start[fits]] >= v[fits]
        at = np.where(fits, at - step if back else at + step, at)
    return at - 1 if back else at


def across(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The intervals that lie in several blocks, and least by (block, v, side) of the open values."""
    spark = parts.sparkSession
    # four numbers a block
    summary = parts.filter("kind = 'block'").select("block", "v", "least", "bytes", "leaves", "size").orderBy("block").toPandas()
    low, ids = minima(summary.v.to_numpy(np.int64)), minima(summary.least.to_numpy(np.int64))
    sums = {k: np.concatenate([[0], np.cumsum(summary[k].to_numpy(np.int64))]) for k in ("bytes", "leaves", "size")}
    known = spark.sparkContext.broadcast((low, ids, sums))
    kinds = "block long, v long, side string, kids long, lb long, rb long, least long, bytes long, leaves long, size long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, ids, sums = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            block, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lb, rb = nearest(low, block, v, True), nearest(low, block, v, False)
            for own, column in ((lb, batch.column(4)), (rb, batch.column(5))):  # an end inside the block
                inside = np.asarray(column.is_valid())
                own[inside] = block[inside]
            some = rb - lb > 1
            middle = np.full(len(v), np.iinfo(np.int64).max)
            middle[some] = least(ids, lb[some] + 1, rb[some] - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lb), pa.array(rb), pa.array(middle), *(pa.array(sums[k][rb] - sums[k][lb + 1]) for k in ("bytes", "leaves", "size"))], names)

    own = parts.filter("kind = 'open'").select(*names[:6]).mapInArrow(run, kinds)
    ends = ["i", "v", "side", "size", "least", "bytes", "leaves"]
    tail = parts.filter("kind = 'tail'").select(F.col("block").alias("lb"), F.struct(*ends, "n", "c").alias("t"))
    head = parts.filter("kind = 'head'").select(F.col("block").alias("rb"), F.struct(*ends).alias("h"))
    key, rest = ["block", "v", "side"], ["kids", "lb", "rb", "least", "bytes", "leaves", "size"]
    own = own.join(tail, "lb").filter("t.v < v").groupBy(*key, *rest).agg(F.max("t").alias("t"))
    own = own.join(head, "rb", "left").groupBy(*key, *rest, "t").agg(F.min(F.when(F.col("h.v") < F.col("v"), F.col("h"))).alias("h"))
    by_low = F.col("t.v") >= F.coalesce("h.v", F.lit(-1))

    def total(c: str) -> Column:
        return F.col(c) + F.col(f"t.{c}") + F.coalesce(f"h.{c}", F.lit(0))

    found = own.select(
        *key, "kids", F.col("t.i").alias("i"), F.col("t.c").alias("c"), F.greatest("t.v", F.coalesce("h.v", F.lit(-1).cast("long"))).alias("p"),
        F.when(by_low & (F.col("t.v") < 0), None).when(by_low, F.col("lb")).otherwise(F.col("rb")).alias("pblock"), F.when(by_low, F.col("t.v")).otherwise(F.col("h.v")).alias("pv"), F.when(by_low, F.col("t.side")).otherwise(F.col("h.side")).alias("pside"),
        total("size").alias("size"), F.least("least", "t.least", "h.least").alias("least"), total("bytes").alias("bytes"), total("leaves").alias("leaves"), F.col("t.n").alias("n"),
    )
    found = materialise(found, "trie-across")
    # equal values of several blocks are one node
    merged = found.groupBy("i", "v").agg(*(F.first(c).alias(c) for c in ("c", "p", "pblock", "pv", "pside", "size", "least", "bytes", "leaves")), (F.sum("kids") + F.first((F.col("n") > F.col("v")).cast("long"))).alias("kids"), F.first(F.col("n") == F.col("v")).alias("ends"))
    return merged.withColumn("parent", F.lit(None).cast("long")).select(*_NODE), found.select("block", "v", "side", "least")


def digests(order: DataFrame) -> DataFrame:
    """(i, digest) by the first of equal conversations: SHA-256 of their ids, ascending and comma-joined.

    One running hash takes the ids of one node, so they pass one task, an id at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, out = None, None, []
        for batch in batches:
            for rank, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rank == here:
                    state.update(b",%d" % c)
                    continue
                if state is not None:
                    out.append((here, state.hexdigest()))
                here, state = rank, hashlib.sha256(b"%d" % c)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["i", "digest"])
                out = []
        if state is not None:
            out.append((here, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["i", "digest"])

    return order.select("rank", "c").repartition("rank").sortWithinPartitions("rank", "c").mapInArrow(run, "i long, digest string")


def trie(turns: DataFrame, share: int = SHARE, heads: int = HEADS, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations (see `rebuilt`).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the UTF-8
    bytes of each node's last text), ends_sha256 (ids of members with depth
    turns).  turns has conv_id, turn, role, text: null roles and texts are
    empty, null turns come first, equal turns are ordered by role and text, and
    repeated rows are turns of their own.  Rows with null conv_id belong to no
    conversation.  c % share takes the sign of c.  Without conversations there
    are no nodes.  Other columns are ignored.
    """
    rows, talks = rebuilt(turns, share, heads, segment)
    order, segments = ordered(rows, talks, segment)
    order = materialise(order, "trie-order")
    parts = blocks_of(common_prefixes(order, segments, rows, segment), block)
    wide, least_of = across(parts)
    inside = parts.filter("kind in ('inner', 'own')").select(*_NODE)
    nodes = inside.unionByName(wide)
    looked_up = least_of.select(F.col("block").alias("pblock"), F.col("v").alias("pv"), F.col("side").alias("pside"), F.col("least").alias("found"))
    # at most one block's nodes have one key; those that know their parent have none
    found = nodes.filter("pblock is not null").join(looked_up, ["pblock", "pv", "pside"]).withColumn("parent", F.col("found"))
    own = [c for c in _NODE if c not in ("pblock", "pv", "pside")]
    nodes = nodes.filter("pblock is null").select(*own).unionByName(found.select(*own))
    nodes = nodes.join(digests(order).withColumn("ends", F.lit(True)), ["i", "ends"], "left")
    # depths p + 1 to v, those of a segment of turns at a time
    cut = nodes.filter("v > 0").withColumn("s", F.explode(F.expr(f"sequence(greatest(p, 0) div {segment}, (v - 1) div {segment})")))
    at = rows.select("c", "pos", "low", F.expr(f"pos div {segment}").alias("s"))
    deep = cut.join(at, ["c", "s"]).filter("pos >= p and pos < v").withColumn("depth", F.col("pos") + 1).drop("pos", "s")
    root = nodes.filter("p = -1").withColumns({"low": F.lit(0).cast("long"), "depth": F.lit(0).cast("long")})
    last = F.col("depth") == F.col("v")
    return deep.unionByName(root).select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("p") + 1, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("size").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("bytes") - (F.col("size") - 1) * F.col("low")).alias("saved_tokens"),
        F.when(last & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
    )
