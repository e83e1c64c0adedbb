"""The prefix trie against a plain one and against its parts' definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestream.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, share=5, heads=9):
    """Nodes of a dictionary trie: {(conv_id, depth, ...)} as sorted rows."""
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(own.get(c - int(np.fmod(c, share)), [])[:h] + own[c][h:])
    members, children = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            children.setdefault(turns[:d], set())
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if made[c] == node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_talks(seed, n, most, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-10, 4 * n), n):
        rows += [(c, None if k == 0 and r.random() < 0.1 else k, r.choice(["user", "user", None]), r.choice(words)) for k in range(r.choice([0, 1, 2, most, r.randrange(most)]))]
    return rows


def got(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, KINDS).repartition(3)
    return sorted((tuple(x) for x in prefix_trie.trie(frame, **sizes).collect()), key=repr)


@pytest.mark.parametrize("seed,n,most,words,segment,block", [(1, 40, 6, ["a", "", None], 256, 16384), (2, 60, 12, ["a", "é"], 2, 4), (3, 90, 30, ["a", "b"], 4, 7), (4, 50, 5, ["a"], 3, 1), (5, 120, 4, ["a", "b", "c", "dd"], 1, 16)])
def test_trie_equals_a_plain_one(spark, seed, n, most, words, segment, block):
    rows = random_talks(seed, n, most, words)
    assert got(spark, rows, segment=segment, block=block) == plain_trie(rows)


def test_trie_edges(spark):
    same = [(c, k, "user", f"t{k}") for c in range(1000, 1040) for k in range(9)]
    rows = same + [(7, 0, "user", "only"), (8, 0, None, None), (8, 0, None, None), (None, 0, "user", "no id"), (2001, 0, "u", "x" * 50_000), (-7, None, "user", "n"), (-7, 3, "user", "m")]
    frame = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], KINDS + ", i long, side string, block long")
    assert sorted((tuple(x) for x in prefix_trie.trie(frame, segment=4, block=8).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.trie(frame.limit(0)).count() == 0
    assert prefix_trie.trie(frame.filter("conv_id is null")).count() == 0
    one = [(1, 0, "user", "x")]  # its base is absent, so it has no turns
    assert got(spark, one) == plain_trie(one)


def test_nearest_smaller_values_equal_brute_force():
    r = random.Random(1)
    for _ in range(200):
        v = np.array([r.randrange(4) for _ in range(r.randrange(1, 40))])
        left, right = prefix_trie.smaller(v)
        table = prefix_trie.minima(v)
        for i, x in enumerate(v):
            assert left[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert right[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))
        i = np.arange(len(v))
        assert (prefix_trie.nearest(table, i, v, True) == left).all() and (prefix_trie.nearest(table, i, v, False) == right).all()
        low = np.array([r.randrange(len(v)) for _ in range(9)])
        high = np.array([r.randrange(a, len(v)) for a in low])
        assert prefix_trie.least(table, low, high).tolist() == [v[a : b + 1].min() for a, b in zip(low, high)]
