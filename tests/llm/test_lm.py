"""The language model against plain counting, with chunks and blocks of every size, and its edges."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + ["</s>"]


def plain(texts, learn, order):
    """(score, base, known) of each text by counters; cells of held-out estimates as the operator states them."""
    texts = [words_of(t) for t in texts]
    grams = lambda w, o: [tuple((["<s>"] * (order - 1) + w)[i + order - o : i + order]) for i in range(len(w))]
    total, seen = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for w, use in zip(texts, learn, strict=True):
        if use:
            for o in range(order):
                total[o].update(grams(w, o + 1))
                seen[o].update(g[:-1] for g in grams(w, o + 1))
    n, known = sum(total[0].values()), len(total[0])

    def of(g, own, own_seen, out):
        f, bucket = [], 0
        for o in range(order):
            part = g[order - 1 - o :]
            c, h = total[o][part] - own[o][part], (seen[o][part[:-1]] - own_seen[o][part[:-1]]) if o else n - out
            f.append(c / h if h > 0 else 0.0)
            if o and h > 0:
                bucket = (o - 1) * lm.BINS + h.bit_length()
        return bucket, f

    nothing, cells = [Counter()] * order, defaultdict(list)
    for w, use in zip(texts, learn, strict=True):
        if use:
            own, own_seen = [Counter(grams(w, o + 1)) for o in range(order)], [Counter(g[:-1] for g in grams(w, o + 1)) for o in range(order)]
            for g in grams(w, order):
                bucket, f = of(g, own, own_seen, len(w))
                cells[bucket, tuple(min(255, max(1, 1 + round(-math.log2(x) * lm.GRAIN))) if x > 0 else 0 for x in f)].append(f)
    even = 1 / (known + 1)
    rows = [(b, len(f), [even, *np.mean(f, axis=0)]) for (b, _), f in cells.items()]
    whole, by_bucket = lm.weights(np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int), np.array([r[2] for r in rows]).reshape(-1, order + 1))
    out = []
    for w in texts:
        score = 0.0
        for g in grams(w, order):
            bucket, f = of(g, nothing, nothing, 0)
            score += math.log10(float(np.dot(by_bucket[bucket] if bucket < len(by_bucket) else whole, [even, *f])))
        base = sum(math.log10((total[0][(x,)] + 0.5) / (n + 0.5 * (known + 1))) for x in w)
        out.append((len(w), sum(total[0][(x,)] > 0 for x in w), n, base, score))
    return out


def fold(id="doc_id"):
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


def run(spark, texts, order=lm.ORDER):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in lm.score(docs, fold() != 1, fold() == 1, order=order).collect()}
    return [tuple(rows[i][2:]) for i in range(len(texts))], [rows[i]["held_out"] for i in range(len(texts))]


def check(spark, texts, order=lm.ORDER):
    learn = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    found, held = run(spark, texts, order)
    assert held == [not x for x in learn]
    for a, b in zip(found, plain(texts, learn, order), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)


def made(n=60, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'Aé'[k % 2]}w{k}" for k in range(40)]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=np.arange(40, 0, -1) / 820)) + "\t\n"[: i % 3] for i in range(n)] + [None, "", " \r\n", "new words only"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_counting(spark, order):
    check(spark, made(), order)


def test_chunks_and_blocks_of_any_size(monkeypatch):
    """Streams of many small chunks are those of one large one: same tokens, contexts, texts."""
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(lm.TaskContext, "get", lambda: Task)
    texts = [*made(20), "x" * 300, " " + "yz" * 200 + " tail", " " * 99 + "after", "a " * 90, "ab" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts)), pa.array([False] * len(texts))], names=["id", "text", "learn", "held"])

    def streams(order):
        out = defaultdict(list)
        for part in lm._chunked(iter([batch]), order):
            for c in part.to_pylist():
                words, seq, at = np.frombuffer(c["words"], np.uint64), lm._unpacked(c["seq"], np.uint32), 0
                for n, opens, row in zip(c["lengths"], c["opens"], c["row"], strict=True):
                    stream = words[seq[at : at + n]].tolist()
                    before = out[row][len(out[row]) - order + 1 :] if order > 1 else []
                    assert opens == (row not in out or not out[row]) and (opens or stream[: order - 1] == before)
                    out[row] += stream if opens else stream[order - 1 :]
                    at += n
        return out

    for order in (1, 2, 3):
        whole = streams(order)
        assert [len(v) for _, v in sorted(whole.items())] == [len(words_of(t)) + order - 1 for t in texts]
        for block, chunk in ((64, 8), (64, 1000), (16, 3), (1 << 20, 5)):
            monkeypatch.setattr(lm, "BLOCK", block)
            monkeypatch.setattr(lm, "CHUNK", chunk)
            assert streams(order) == whole
        monkeypatch.undo()
        monkeypatch.setattr(lm.TaskContext, "get", lambda: Task)


def test_words_are_told_apart_as_patterns_tell_them():
    text = "One two\x0bthree four five ONE one É é"
    begin, h = lm._hashed(np.frombuffer(text.encode(), np.uint8))
    words = words_of(text)[:-1]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert lm._long_word(np.frombuffer(b" one", np.uint8))[0] == h[0]


def test_weights_make_held_out_tokens_likelier():
    rng = np.random.default_rng(1)
    f = rng.random((500, 3)) ** 4
    bucket, n = rng.integers(0, 4, 500), rng.integers(1, 9, 500)
    whole, by = lm.weights(bucket, n, f, prior=1e-9)
    assert np.allclose(by.sum(axis=1), 1) and np.isclose(whole.sum(), 1)
    said = lambda w: float((n * np.log((w[bucket] * f).sum(axis=1))).sum())
    assert all(said(by) >= said(0.98 * by + 0.02 * other) - 1e-6 for other in np.eye(3)[None].repeat(4, 0).transpose(1, 0, 2))
    assert said(by) >= said(np.tile(whole, (4, 1))) - 1e-6


def test_mixture_is_a_distribution(spark):
    """Without contexts a text of one word has that word's probability times the end's: all words, an unknown one and the end make one."""
    texts = ["a b", "a c a b", "b a", "c", "a b c", "a a b", ""]
    rows = [("t", t) for t in texts] + [(w, w) for w in "abcz"] + [("", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score(docs, F.col("doc_id") == "t", F.lit(False), order=1).where("doc_id <> 't'").collect()}
    assert sum(got[w] / got[""] for w in "abcz") + got[""] == pytest.approx(1)


def test_edges(spark, edge):
    out = lm.score(edge, fold() != 1, fold() == 1)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert len(rows) == edge.count() and sum(r["doc_id"] == 7 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 8)} == {1}
    assert lm.score(edge.limit(0), fold() != 1, fold() == 1).collect() == []
    none = lm.score(edge, F.lit(None).cast("boolean"), fold() == 1).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0 for r in none)
