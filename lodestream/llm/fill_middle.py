"""Fill-in-middle transformation with a two-pass streaming matcher.

A text is cut after two units chosen by hash.  The first pass over the unit
pattern's matches counts them; the second advances a lazy iterator of matches
to the smaller, then to the larger rank and notes where it stands.  No array of
units, offsets or pieces is ever held, so beyond the text itself the memory is
constant, however many units a text has.

Rows are independent: no shuffle, and a lost task repeats its own rows only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import null_to_empty, slices

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50


def cuts(pattern: re.Pattern, text: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle): the ends after the smaller and larger of first and second modulo units + 1."""
    n = sum(1 for _ in pattern.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    units = pattern.finditer(text)

    def advance(by: int, at: int) -> int:
        last = next(islice(units, by - 1, None), None) if by else None
        return last.end() if last else at

    a = advance(low, 0)
    return n, a, advance(high - low, a)


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers that could overlap one another or themselves would make the output ambiguous."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {markers} overlap each other")
    if len(set(markers)) < 3:
        raise ValueError(f"markers {markers} are not distinct")


def transform(docs: DataFrame, seed: int = SEED, pattern: str = LINES, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: a row for each row of docs.

    pattern cuts a text into units that follow each other without gaps (it is
    not checked); its matches are taken over code points.  An empty text, one
    that holds a marker, and the share beyond fim_percent stay plain, with null
    lengths.  Null texts are empty.  The hash takes seed and doc_id, so rows
    that repeat an id draw alike, and a null doc_id draws as the word "null".
    Other columns are ignored.
    """
    check_markers(markers)
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 21):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()):
                    digest = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
                    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
                    n, low, high = cuts(units, text, h[0], h[1])
                    if not text or any(x in text for x in markers) or h[2] % 100 >= fim_percent:
                        rows.append((doc, n, "plain", None, None, text))
                    elif h[3] % 100 < spm_percent:
                        rows.append((doc, n, "spm", low, high - low, f"{s}{text[high:]}{p}{text[:low]}{m}{text[low:high]}"))
                    else:
                        rows.append((doc, n, "psm", low, high - low, f"{p}{text[:low]}{s}{text[high:]}{m}{text[low:high]}"))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_to_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made of, from it and its form alone (null stays null).

    A transformed text holds no marker, so the first marker met is the one that was put in.
    """
    p, s, m = (F.lit(x) for x in markers)

    def after(text: Column, marker: Column, by: int) -> Column:
        return F.substr(text, F.position(marker, text) + F.lit(by))

    def until(text: Column, marker: Column) -> Column:
        return F.substr(text, F.lit(1), F.position(marker, text) - F.lit(1))

    lp, ls, lm = (len(x) for x in markers)
    tail = after(output, m, lm)
    psm = F.substr(output, F.lit(lp + 1))
    spm = F.substr(output, F.lit(ls + 1))
    as_psm = F.concat(until(psm, s), tail, until(after(psm, s, ls), m))
    as_spm = F.concat(until(after(spm, p, lp), m), tail, until(spm, p))
    return F.when(form == "psm", as_psm).when(form == "spm", as_spm).otherwise(output)
