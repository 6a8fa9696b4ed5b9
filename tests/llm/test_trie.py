"""The prefix trie against plain dictionaries, contraction on trees of every shape, and edges."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import trie as T
from tessera.llm._common import Scratch

SCHEMA = "conv_id bigint, turn int, role string, text string"


def plain(rows):
    """Rows of the trie by (conv_id, depth), by loops."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c in turns:
        turns[c] = [t[1:] for t in sorted(turns[c])]
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ended[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    out, below = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[c][0] for c in children[p]) or 1, saved + sum(below[c][1] for c in children[p]))
        digest = hashlib.sha256(",".join(map(str, ended[p])).encode()).hexdigest()
        out[members[p][0], len(p)] = (members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), *below[p], digest)
    return out


def check(spark, rows):
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain(rows)
    assert len(got) == len(want) and {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == want
    return got


def test_equals_plain_dictionaries(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(-7, 90):
        if c % 11 == 0:
            continue
        opening = [("user", f"hello {rng.integers(3)}")] * int(rng.integers(0, 4))
        turns = opening + [(["user", "assistant", None][rng.integers(3)], ["é", "", None, "yes", "no"][rng.integers(5)]) for _ in range(rng.integers(0, 9))]
        rows += [(c, int(t), r, x) for t, (r, x) in enumerate(turns)]
    rows += [(c, t, "user", "same") for c in range(200, 230) for t in range(12)]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(70)] + [(501, 3, "a", "x"), (501, None, "z", "first")]
    rng.shuffle(order := list(range(len(rows))))
    got = check(spark, [rows[i] for i in order])
    assert max(r["depth"] for r in got) == 70


def test_ambiguous_joins_of_role_and_text(spark):
    """Roles and texts that join to the same string, or the same turns at other places, are other nodes."""
    rows = [(900, 0, "ab", "c"), (901, 0, "a", "bc"), (902, 0, "", "abc"), (905, 0, "x", "1"), (905, 1, "x", "2"), (906, 0, "x", "2"), (906, 1, "x", "1"), (910, 0, None, "x:1"), (911, 0, "x", ":1")]
    check(spark, rows)


@pytest.mark.parametrize("shape", ["path", "star", "random", "comb"])
def test_contraction_of_any_tree(spark, shape):
    rng, n = np.random.default_rng(3), 150
    up = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(i)), "comb": lambda i: i - 1 if i % 2 == 0 or i < 2 else i - 2 + i % 2}[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    weight = rng.integers(-50, 1000, n).tolist()
    counts = np.bincount([p for p in parent if p is not None], minlength=n).tolist()
    node = lambda i: None if i is None else (i, -i)
    tree = spark.createDataFrame([(node(i), node(parent[i]), counts[i], weight[i]) for i in range(n)], f"node {T.NODE}, parent {T.NODE}, n_children bigint, weight bigint")
    totals = [[int(counts[i] == 0), weight[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        totals[parent[i]][0] += totals[i][0]
        totals[parent[i]][1] += totals[i][1]
    got = {r["node"]["a"]: [r["leaves"], r["saved"]] for r in T.subtree_totals(tree, Scratch(spark), most=30).collect()}
    assert got == dict(enumerate(totals))


def test_edges(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    # 4 has no base and lends nothing, so its first turns are dropped: the root alone is left
    turnless = [(c, 0, "user", "x") for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1]
    (root,) = check(spark, turnless)
    assert root["depth"] == 0 and root["n_leaves"] == 1 and root["n_convs"] == len(turnless)
    repeated = [(10, 1, "user", "x"), (10, 1, "user", "x"), (10, 2, None, None), (15, None, "user", "long " * 5000)]
    got = check(spark, repeated)
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in repeated], f"{SCHEMA}, node int, pos int, _segment int")
    assert sorted(map(str, T.prefix_trie(d).collect())) == sorted(map(str, got))


def test_ends_of_a_hot_node_over_many_segments(spark):
    scratch, top = Scratch(spark), "named_struct('a', 0L, 'b', 0L)"
    many = spark.range(20_000).selectExpr(f"{top} as node", "id as conv").union(spark.sql("select named_struct('a', 1L, 'b', id) as node, id + 5 as conv from range(50)"))
    got = {(r["node"]["a"], r["node"]["b"]): r["ends_sha256"] for r in T.ends(many, scratch).collect()}
    assert len(got) == 51 and got[0, 0] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    assert got[1, 7] == hashlib.sha256(b"12").hexdigest()
