"""Packing and fill-in-middle against brute force and plain rules."""

import binascii
import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pytest

from lodestream.llm import entries, fill_middle, packing, word_bpe
from lodestream.llm.common import materialise, numbered
from pyspark.sql import functions as F
from test_training_data import SCHEMA, docs, empty, prose, texts  # noqa: F401

# 11


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_library():
    r = random.Random(5)
    odd = ["", " ", "É'S'll l'été 12½ «x» _-_", "İstanbul ΣΑΣ", "<|endoftext|> x <|startoftext|>", "\x1c\x1d \x85\xa0 a\x00b", "x'" * 900, "é中文 \U0001f600 Straße ½", "n" * 5000, "Ⱥȿ ǅ ŉ ẞ K Å", "é 가", "'sea 's 'LL don't"]
    odd += ["".join(r.choice("abcÄß'´ 0129²\t\n.,-_<|>éŁ") for _ in range(r.randrange(60))) for _ in range(300)]
    codec, ids = word_bpe.WordCodec(word_bpe.default_vocabulary(), limit=50), library()
    for a in range(0, len(odd), 40):
        for text, got in zip(odd[a : a + 40], codec.encode_many(odd[a : a + 40])):
            assert np.frombuffer(got, "<u4").tolist() == ids(text), text


def check_packed(rows, want, budget, least):
    """Every id once, in gapless sequences; padding below `least` a sequence but for the powers of two."""
    own, seqs = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        own.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        assert sum((p for _, p in sorted(own[doc, len(ids)])), []) == ids
        assert [s for s, _ in sorted(own[doc, len(ids)])] == np.cumsum([0] + [len(p) for _, p in sorted(own[doc, len(ids)])])[:-1].tolist()
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= budget and (budget - at < least or at & (at - 1) == 0)


@pytest.mark.parametrize("lane_docs,fan,partitions", [(4096, 64, 3), (5, 2, 1), (5, 2, 7)])
def test_packing_keeps_every_id_once(spark, lane_docs, fan, partitions):
    ids, r = library(), random.Random(3)
    table = [(k, prose(k, r.choice([0, 1, 3, 20, 90, 700]))) for k in range(60)] + [(90, None), (91, ""), (92, prose(5, 3000))]
    want = {k: ids(t or "") + [2] for k, t in table}
    frame = spark.createDataFrame([(*t, "x", 1) for t in table], "doc_id long, text string, ids string, n int").repartition(partitions)
    packed = materialise(packing.pack(frame, budget=256, open_windows=4, least_cut=8, lane_docs=lane_docs, fan=fan), "p")
    rows = packed.collect()
    check_packed(rows, want, 256, 8)
    whole = {r.sequence_id: r for r in packing.sequences(packed, 256).collect()}
    for key in {r.sequence_id for r in rows}:
        parts = sorted((r.offset, r.doc_id, r.ids) for r in rows if r.sequence_id == key)
        body = b"".join(p[2] for p in parts)
        n = len(body) // 4
        assert whole[key].length == n and whole[key].doc_ids == [p[1] for p in parts] and whole[key].starts == [p[0] for p in parts]
        assert whole[key].ids == (body if n & (n - 1) == 0 else body + np.array([2] * (256 - n), "<u4").tobytes())
    test_packing_keeps_every_id_once.seen = getattr(test_packing_keeps_every_id_once, "seen", {})
    digest = sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows)
    assert test_packing_keeps_every_id_once.seen.setdefault(lane_docs, digest) == digest, "the split of the input must not matter"


def plain_lane(lengths, budget, limit, least):
    """Best fit with a bounded number of windows: (sequences in order, windows left)."""
    done, windows = [], []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= budget:
            done.append([(doc, at, budget)])
            at += budget
        while at < n:
            fits = [w for w in windows if budget - sum(p[2] for p in w) >= n - at]
            if fits:
                best = min(fits, key=lambda w: budget - sum(p[2] for p in w))
                best.append((doc, at, n - at))
                at = n
                if sum(p[2] for p in best) == budget:
                    done.append(best)
                    windows = [w for w in windows if w is not best]
            elif len(windows) < limit:
                windows.append([(doc, at, n - at)])
                at = n
            else:
                full = min(windows, key=lambda w: budget - sum(p[2] for p in w))
                gap = budget - sum(p[2] for p in full)
                if gap >= least:
                    full.append((doc, at, gap))
                    at += gap
                done.append(full)
                windows = [w for w in windows if w is not full]
    return done, windows


def test_lane_equals_plain_best_fit():
    r = random.Random(8)
    for _ in range(60):
        budget, limit, least = r.choice([16, 64, 100]), r.choice([1, 3, 8]), r.choice([1, 5, 200])
        lengths = [r.choice([1, 2, 7, 15, 31, 63, 64, 100, 333]) for _ in range(r.randrange(120))]
        lane = packing.Lane(budget, limit, least)
        got = [own for doc, n in enumerate(lengths) for own in lane.add((doc,), 0, n)]
        done, left = plain_lane(lengths, budget, limit, least)
        assert got == done and sorted(lane.left()) == sorted(left) and len(left) <= limit
        merged = list(lane.merged())
        assert sorted(k for own in merged for d, s, n in own for k in ((d, x) for x in range(s, s + n))) == sorted(k for own in left for d, s, n in own for k in ((d, x) for x in range(s, s + n)))
        assert all((n := sum(p[2] for p in own)) == budget or n & (n - 1) == 0 for own in merged)


def test_packing_edges(spark, docs):  # noqa: F811
    ids = library()
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == sorted((i is None, i or 0, len(ids(t or "")) + 1) for i, t in texts())
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, budget=0)


def test_query_has_the_contract_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entries.op11_packing(spark, str(tmp_path)).collect()}
    want = np.array([*library()("one two"), 2], "<u4").tobytes()
    assert got[1].ids_crc32 == binascii.crc32(want) and got[1].doc_tokens == len(want) // 4 and got[2].length == 1


def test_numbering_depends_on_rows_only(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, 2, 3]), r.choice([None, "a", "b"]), k) for k in range(3000)]
    for parts in (1, 5):
        table = materialise(spark.createDataFrame(rows, "a long, b string, k long").repartition(parts), "t")
        spark.conf.set("spark.sql.shuffle.partitions", 3 * parts)
        got = numbered(table, ["a", "b"], ["k"], ["a", "b", "k"]).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2]))
        first = {}
        for i, x in enumerate(want):
            first.setdefault(x[:2], i)
        assert sorted((g["index"], g["rank"], g.a, g.b, g.k) for g in got) == [(i, first[x[:2]], *x) for i, x in enumerate(want)]
    assert numbered(materialise(spark.createDataFrame([], "a long"), "t"), ["a"], [], ["a"]).count() == 0


# 12


def plain_middle(doc, text, percent=100):
    h = hashlib.sha256(f"7:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, form, len(parts[0]), len(parts[1]), out


@pytest.mark.parametrize("percent", [100, 40])
def test_middles_equal_brute_force_and_restore(spark, docs, percent):  # noqa: F811
    r = random.Random(4)
    own = [(k, "".join(r.choice(["a", "é", "\n", "\n\n", "<", "P", ">", "S<", "\r", " ", "中\U0001f600"]) for _ in range(r.randrange(40)))) for k in range(100, 300)]
    own += [(400, "x<M>y"), (401, "\n" * 5000), (402, "ab" * 200_000), (403, "<P"), (404, "no end")]
    table = spark.createDataFrame(own, "doc_id long, text string").withColumn("output", F.lit("clash")).unionByName(docs.filter("doc_id is not null").select("doc_id", "text", F.lit("c").alias("output")))
    made = fill_middle.transform(table, fim_percent=percent)
    got = made.select("*", fill_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    want = [(i, *plain_middle(i, t or "", percent), t or "") for i, t in own + [x for x in texts() if x[0] is not None]]
    assert sorted((tuple(g) for g in got), key=repr) == sorted(want, key=repr)
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_middle_edges(spark):
    assert fill_middle.transform(empty(spark)).count() == 0
    got = fill_middle.transform(spark.createDataFrame([(None, "a\nb"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(((g.doc_id, g.n) for g in got), key=repr) == [(None, 0), (None, 2)]
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("<P>", "P", "z"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.check_markers(bad)


def test_cuts_hold_no_units():
    """The matcher's iterators advance as far as asked and no list is built."""

    class Once:
        def __init__(self):
            self.passes = 0

        def finditer(self, text):
            self.passes += 1
            return re.finditer(r"[^\n]*\n|[^\n]+", text)

    p = Once()
    assert fill_middle.cuts(p, "a\nbb\nccc", 2, 1) == (3, 2, 5) and p.passes == 2
    assert fill_middle.cuts(p, "", 5, 9) == (0, 0, 0)
