import numpy as np
import pyarrow as pa

from tessera.llm import neighbours as N

FOUND = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def test_a_branch_is_ranked_in_blocks_of_queries(monkeypatch):
    """The best of the leaves that each query visits, as by looking at them one by one; not a pass of its own for each query."""
    rng = np.random.default_rng(3)
    x, q, leaf = rng.normal(size=(900, 16)), rng.normal(size=(300, 16)), rng.integers(4, 20, 900).astype(np.int32)
    x[:40] = x[40:80]
    leaves = [sorted(rng.choice(24, rng.integers(1, 20), replace=False).tolist()) for _ in q]
    leaves[0], leaves[1] = [0], [int(leaf[0])]  # a leaf without vectors; one leaf
    filed = pa.table({"leaf": leaf, "ids": pa.array([[i] for i in range(len(x))]), "v": pa.array(x.tolist())})
    asked = pa.table({"leaves": pa.array(leaves, pa.list_(pa.int32())), "q": np.arange(len(q)), "v": pa.array(q.tolist())})
    passes, partition = [], np.partition
    monkeypatch.setattr(N.np, "partition", lambda *a, **k: passes.append(1) or partition(*a, **k))
    got: dict[int, set] = {}
    for r in N._ranked(asked, filed, 16, 6, FOUND).to_pylist():
        got.setdefault(r["q"], set()).add((r["ids"][0], round(r["score"], 12)))
    assert len(passes) < 10
    for i, wanted in enumerate(leaves):
        rows = np.flatnonzero(np.isin(leaf, wanted))
        cosine = x[rows] @ q[i] / (np.linalg.norm(x[rows], axis=1) * np.linalg.norm(q[i]))
        least = np.sort(cosine)[-6:][0] - 1e-9 if len(rows) else 2
        assert got.get(i, set()) == {(int(r), round(float(c), 12)) for r, c in zip(rows, cosine, strict=True) if c >= least}
