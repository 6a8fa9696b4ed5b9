import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as S
from tessera.llm.graph import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", None, "a", "A b C", "one two three four", "x y z w " * 9 + "É e\x0b q", "Ä Ö Ü ä"):
        assert S.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("budget", [2, 3, 4, 6])
@pytest.mark.parametrize("long_chain", [False, True])
def test_no_pair_is_missed(budget, long_chain):
    rng = np.random.default_rng(1)
    masks = np.array(S.key_masks(budget, long_chain), np.uint64)
    x = rng.integers(0, 2**63, 5000).astype(np.uint64)
    d = np.zeros_like(x)
    for _ in range(budget):
        d |= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    y = x ^ d
    assert ((x[:, None] & masks) == (y[:, None] & masks)).any(axis=1).all()
    many = np.unique(np.concatenate([x[:100], y[:100], x[:100] ^ np.uint64(7)]))
    for q in many[:60]:
        assert (S.within_budget(many, q, budget) == (np.bitwise_count(many ^ q) <= budget)).all()


def roots_of(values, budget=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("block,long_chain", [(4096, False), (3, False), (3, True)])
def test_links_join_the_same_classes(spark, block, long_chain):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    values = {int(v) for v in rng.integers(0, 2**62, 40)} | {base ^ sum(1 << int(b) for b in rng.choice(12, 5, replace=False)) for _ in range(60)} | {base ^ (0b11111 << 40), 0, 0b1111, 0b11111111}
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = connected_components(S.links(df, long_chain=long_chain, block=block), "a", "b")
    root = {r["node"]: r["root"] for r in found.collect()}
    want = roots_of(values)
    assert [root.get(v, v) for v in values] == [min(values[k] for k in range(len(values)) if want[k] == want[i]) for i in range(len(values))]


def test_documents(spark, edge):
    out = S.components(edge).collect()
    got = {(r["doc_id"], r["component_id"]) for r in out}
    assert len(out) == edge.count() and got == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 5), (7, 7), (None, None), (8, 2)}
    kept = S.keep_one(edge)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 5, 7] and kept.columns == edge.columns
    assert S.components(edge.limit(0)).count() == 0 and S.keep_one(edge.limit(0)).count() == 0


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 9), (None, 1), (8, 7), (7, 8)], "a int, b int")
    assert {tuple(r) for r in connected_components(links, "a", "b").collect()} == {(5, 1), (4, 1), (3, 1), (2, 1), (8, 7)}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def test_keep_one_of_ids_that_repeat_or_lack(spark):
    """One row of each class stays, whatever the ids: two texts under one id, copies without an id, rows that repeat."""
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(1, words(1)), (1, words(2)), (2, words(1)), (3, words(2)), (None, words(3)), (None, words(3)), (None, words(4)), (4, words(4)), (5, words(5)), (5, words(5)), (6, None), (None, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, _rows int").repartition(3)
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in S.keep_one(df).collect())
    assert got == sorted([(1, words(1)), (1, words(2)), (-1, words(3)), (4, words(4)), (5, words(5)), (6, "")])
