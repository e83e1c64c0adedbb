import numpy as np
import pyarrow as pa
import pytest

from lodestream.operators import tiles


def _table(name, ids, vectors):
    return pa.table({name: pa.array(ids), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})


@pytest.mark.parametrize("copies", [0.0, 0.5])
def test_nearest_equals_brute_force_and_scores_few_pairs(monkeypatch, copies):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6_000, 16)).astype(np.float32)
    vectors[rng.random(len(vectors)) < copies] = vectors[0]
    ids, asked = rng.permutation(len(vectors)), np.arange(40)
    scored, steps = [], tiles.steps
    monkeypatch.setattr(tiles, "steps", lambda x, digits: scored.append(x.size) or steps(x, digits))
    monkeypatch.setattr(tiles, "CHUNK", 500)
    got = tiles.nearest(7)(_table("query_id", ids[asked], vectors[asked]), _table("item_id", ids, vectors))
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    near = np.rint(unit[asked] @ unit.T * 1e6)
    want = set()
    for k in asked:
        order = [j for j in np.lexsort((ids, -near[k])) if j != k][:7]
        want |= {(int(ids[k]), int(ids[j]), near[k, j] / 1e6) for j in order}
    assert set(zip(*(got[c].to_pylist() for c in ("query_id", "item_id", "similarity")))) == want
    if not copies:
        assert sum(scored) < near.size / 4
