"""Chat formatting in budgeted windows.

Prefix sums of the turns' token counts choose windows that begin and end on
turns: each takes the longest run of new turns that fits the budget together
with the retained system turn and the repeated history.  History is the last
turns of the window before, up to its own budget, and is masked, so each
assistant text is a target once.  Tokens are counted on the rendered turn,
role, marks and escapes included.

Template of a turn: "### role: text</turn>\n".  In roles and texts a backslash
escapes itself and both control strings, so reading back is exact.

Scale.  Turns are range-partitioned by conversation and order, so a
conversation with a third of all rows lies in many partitions; each adds up
its own tokens, and one row a partition carries the sums over.  The prefix sum
deals a conversation into segments of SEGMENT budgets, at whose ends a window
ends as well.  A segment, with the history in front of it and the system turn,
is cut by one task that streams its sorted rows and holds one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import materialise

BUDGET, HISTORY = 512, 128
SEGMENT = 256  # budgets: a conversation loses at most one part-filled window in so many
OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
_ROLE_ESCAPES = _ESCAPES | {":": "\\c", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ROLE_ESCAPES.items()}
_CONTROL = re.compile("|".join(map(re.escape, sorted(_ESCAPES, key=len, reverse=True))))
_ROLE_CONTROL = re.compile("|".join(map(re.escape, sorted(_ROLE_ESCAPES, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
WINDOW = "conv_id long, segment long, window long, formatted string, loss array<struct<start:int,end:int>>, first_turn long, n_new long, n_repeated long, n_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN.get(m[1], m[0]), text)


def token_count(text: Column) -> Column:
    """Words and punctuation marks of a text: the stand-in for a tokenizer's count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0))


def shown(role: Column, text: Column) -> Column:
    """The rendered turn, as `_turn` makes it: what the budget counts."""

    def escaped(x: Column, pairs: dict[str, str]) -> Column:
        for plain, safe in pairs.items():  # the backslash first, so none is escaped twice
            x = F.replace(x, F.lit(plain), F.lit(safe))
        return x

    return F.concat(F.lit(OPEN), escaped(role, _ROLE_ESCAPES), F.lit(": "), escaped(text, _ESCAPES), F.lit(CLOSE))


def _turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    head = f"{OPEN}{_ROLE_CONTROL.sub(lambda m: _ROLE_ESCAPES[m[0]], role)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def windows_of(turns: Iterator[tuple[int, int, str, str, int]], budget: int, history: int) -> Iterator[dict]:
    """The windows of one segment, from its turns (kind, position, role, text, tokens): SYSTEM, then PAST, then OWN ones."""
    system = None
    past: list[tuple] = []
    new: list[tuple] = []
    head: list[tuple] = []
    total = number = 0

    def close() -> dict:
        text, loss = "", []
        for masked, some in ((True, head), (False, new)):
            for _, _, role, said, _ in some:
                own, a, b = _turn(role, said)
                if not masked and role == "assistant" and b > a:
                    loss.append({"start": len(text) + a, "end": len(text) + b})
                text += own
        return {"window": number, "formatted": text, "loss": loss, "first_turn": new[0][1], "n_new": len(new), "n_repeated": len(head), "n_tokens": total}

    for turn in turns:
        if turn[0] == SYSTEM:
            system = turn
            continue
        if turn[0] == PAST:
            past.append(turn)
            continue
        if new and total + turn[4] > budget:
            yield close()
            number += 1
            past, new = past + new, []
        if not new:
            # what stands in front: the system turn, and the last turns within the history's and the window's budget
            base = [system] if system and turn[1] > 0 else []
            room = min(history, budget - turn[4] - sum(t[4] for t in base))
            kept: list[tuple] = []
            for old in reversed([t for t in past if not system or t[1] > 0]):
                if old[4] > room:
                    break
                kept.insert(0, old)
                room -= old[4]
            past, head = kept, base + kept
            total = sum(t[4] for t in head)
        new.append(turn)
        total += turn[4]
    if new:
        yield close()


SYSTEM, PAST, OWN = 0, 1, 2
_PREFIX = 32  # characters of a text that may part two ranges


def prefix_sums(turns: DataFrame, tokens: Column) -> DataFrame:
    """conv_id, role, text, tokens, position (from 0) and before (tokens in front) of every turn of its conversation.

    No task sees a whole conversation: ranges of turns number themselves, and
    the conversations that go on over a range's end are carried over.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.greatest(F.lit(0), F.coalesce(tokens, F.lit(0))).cast("long"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    # equal turns and roles may be parted too, by how their texts begin
    begins = F.when(F.length("role") <= _PREFIX, F.substring("text", 1, _PREFIX))
    rows = rows.repartitionByRange(order[0], order[1], F.substring("role", 1, _PREFIX + 1), begins).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, position, before = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = [-1 if c is None else c for c in batch.column(0).to_pylist()]
            null = [c is None for c in batch.column(0).to_pylist()]
            positions, sums = [], []
            for key, n in zip(zip(conv, null), batch.column(4).to_pylist()):
                if key != last:
                    last, position, before = key, 0, 0
                positions.append(position)
                sums.append(before)
                position, before = position + 1, before + n
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(positions, pa.int64()), pa.array(sums, pa.int64())], names)

    names = ["part", "conv_id", "role", "text", "tokens", "position", "before"]
    local = materialise(rows.mapInArrow(run, "part int, conv_id long, role string, text string, tokens long, position long, before long"), "turns")
    sums = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    # a conversation's parts follow each other, so those that go on elsewhere are at most two rows a partition
    same = Window.partitionBy("conv_id")
    ahead = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("parts", F.count(F.lit(1)).over(same)).withColumns({"n0": F.sum("n").over(ahead), "t0": F.sum("t").over(ahead)}).filter("parts > 1 and n0 is not null")
    carried = carried.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "n0", "t0")
    out = local.join(F.broadcast(carried), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", "role", "text", "tokens", (F.col("position") + F.coalesce("n0", F.lit(0))).alias("position"), (F.col("before") + F.coalesce("t0", F.lit(0))).alias("before"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """Formatted windows of conversations (conv_id, turn, role, text).

    formatted is the window's text, loss the code-point spans of assistant
    texts to learn from, n_repeated the masked turns in front (the system turn
    and history), first_turn the place of the first new turn.  Windows of a
    conversation follow each other by segment and window.  tokens counts a
    rendered turn (from role and text; default: its words and signs).  A first
    turn with role system is the system turn.  A turn above the budget gets a
    window of its own.  Null roles and texts are empty; rows with equal turn
    are ordered by role and text, null turns come first, repeated rows are
    turns of their own, and rows with null conv_id are one conversation.
    Other columns are ignored.
    """
    size = max(1, segment) * max(1, budget)
    counted = tokens if tokens is not None else token_count(shown(F.col("role"), F.col("text")))
    rows = prefix_sums(turns, counted).withColumn("segment", F.expr(f"before div {size}"))
    own = rows.select("conv_id", "segment", F.lit(OWN).alias("kind"), "position", "role", "text", "tokens")
    # a turn may be repeated in the next segment if less than the history's budget lies between it and that segment
    past = rows.filter((F.col("before") >= (F.col("segment") + 1) * size - history)).select("conv_id", (F.col("segment") + 1).alias("segment"), F.lit(PAST).alias("kind"), "position", "role", "text", "tokens")
    first = rows.filter("position = 0 and role = 'system'").select(F.col("conv_id").alias("c"), "role", "text", "tokens")
    last = rows.groupBy("conv_id").agg(F.max("segment").alias("last"))
    system = last.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("segment"), F.lit(SYSTEM).alias("kind"), F.lit(0).cast("long").alias("position"), "role", "text", "tokens")
    both = own.unionByName(past).unionByName(system)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def each():
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns))

        source = each()
        ahead = next(source, None)
        while ahead is not None:
            here = ahead[:2]

            def members():
                nonlocal ahead
                while ahead is not None and ahead[:2] == here:
                    yield ahead[2:]
                    ahead = next(source, None)

            for window in windows_of(members(), budget, history):
                out.append({"conv_id": here[0], "segment": here[1]} | window)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span)), ("first_turn", pa.int64()), ("n_new", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64())])
    parts = both.repartition(F.coalesce("conv_id", F.lit(-1)), "segment").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment", "kind", "position")
    return parts.mapInArrow(run, WINDOW)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text and the text's code-point span for each turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        colon = formatted.index(": ", at)
        out.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + 2 : end]), colon + 2, end))
        at = end + len(CLOSE)
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read from their text alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars, loss_sha256 (all text under the mask), formatted_chars,
    n_windows.  Windows may come from a written table: they are dealt by
    conversation and streamed in order.  A digest over a conversation is one
    running hash, so this check, unlike the formatting, reads a conversation
    in one task.  Rows with null conv_id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(s) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([s[0]], pa.int64()), "n_turns": pa.array([s[1]], pa.int64()), "turns_sha256": [s[2].hexdigest()], "loss_chars": pa.array([s[3]], pa.int64()), "loss_sha256": [s[4].hexdigest()], "formatted_chars": pa.array([s[5]], pa.int64()), "n_windows": pa.array([s[6]], pa.int64())})

        finished = []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for row in batch.slice(a, 256).to_pylist():
                    if state is None or state[0] != row["conv_id"]:
                        if state is not None:
                            finished.append(done(state))
                        state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    text = row["formatted"]
                    for role, said, _, _ in parse(text)[row["n_repeated"] :]:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                    for span in row["loss"]:
                        said = unescape(text[span["start"] : span["end"]])
                        state[3] += len(said)
                        state[4].update(said.encode())
                    state[5] += len(text)
                    state[6] += 1
            if finished:
                yield from finished
                finished = []
        if state is not None:
            finished.append(done(state))
        yield from finished

    columns = windows.select("conv_id", "segment", "window", "formatted", "loss", "n_repeated").repartition(F.coalesce("conv_id", F.lit(-1)))
    return columns.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment", "window").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
