import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix as S


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", b"\x00\xff a", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 9, 80, 900):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        text = text + text[: n // 3] + alphabet[:1] * (n // 4)
        assert S.suffix_array(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(500))
    valid = np.arange(500) <= 500 - 13
    counts = Counter(text[i : i + 13] for i in range(488))
    assert S.repeated_windows(text, valid, 13).tolist() == [i < 488 and counts[text[i : i + 13]] > 1 for i in range(500)]
    owner = np.arange(500) // 100
    owners = {}
    for i in range(488):
        owners.setdefault(text[i : i + 13], set()).add(i // 100)
    assert S.repeated_windows(text, valid, 13, owner).tolist() == [i < 488 and len(owners[text[i : i + 13]]) > 1 for i in range(500)]


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((bytes(b for b, g in zip(t, gone) if not g), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())))
    return out


@pytest.mark.parametrize("group", [256, 1])
def test_like_brute_force(spark, group, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(120))
    texts = []
    for i in range(60):
        body = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 150)))
        texts.append(body + (passage[rng.randrange(20) : 120 - rng.randrange(20)] if i % 2 else "") + ("wow " * 30 if i % 7 == 0 else "") + body[:50])
    texts += [texts[3], texts[3], "", "x" * 200]
    raw = [t.encode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in S.remove_repeats(df, length=40, gram=16, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(raw, 40)


def test_parts_of_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(5000)), np.uint8)
    whole = S.cells(data, np.array([5000]), 40, 16)
    assert int(whole[1].sum()) == 4961 and whole[0][0] == 0
    again = S.cells(np.concatenate([data[:1000], data]), np.array([1000, 6000]), 40, 16)
    assert set(whole[2].tolist()) <= set(again[2].tolist())


def test_edges(spark, edge):
    out = S.remove_repeats(edge).collect()
    assert len(out) == edge.count() and {r["doc_id"]: r["n_removed"] for r in out}[5] == 124000
    assert all(r["n_bytes"] == 0 and r["n_spans"] == 0 for r in out if r["doc_id"] in (2, 3))
    assert S.remove_repeats(edge.limit(0)).count() == 0
    rest = S.without_repeats(edge)
    assert rest.columns == edge.columns and sorted(r["doc_id"] or -1 for r in rest.collect()) == [-1, 1, 2, 3, 4, 7, 7, 8]
    two = spark.createDataFrame([(1, "p" * 0 + "head " + "".join(chr(97 + i * i % 23) for i in range(900))), (2, "tail " + "".join(chr(97 + i * i % 23) for i in range(900)))], "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    assert all(r["n_chars"] == len(r["text"]) < 10 for r in S.without_repeats(two).collect())
    with pytest.raises(ValueError):
        S.repeated_spans(edge, length=50, gram=50)


def test_pipeline_cuts_passages_of_51_words(spark):
    """Over 50 words in other documents go, whatever their bytes and line breaks; 50 words, or one document alone, stay."""
    import corpus_pipeline

    rng = random.Random(8)

    def some(n, size=5):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(size)) for _ in range(n)]

    passage, short, own = some(51), some(50), some(51)
    texts = [some(70) + passage + some(90), some(5) + passage + some(3), some(40) + short + some(20), short + some(9), own + some(30) + own, some(51), passage + some(60)]
    assert 300 < len(" ".join(passage)) < 320
    lines = [" ".join(t) for t in texts]
    lines[1] = lines[1].replace(" ", "\n  ")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(lines)] + [(None, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert len(got) == 8 and got[None]["text"] is None
    shared = set(passage)
    for i, words in enumerate(texts):
        assert got[i]["text"].split() == [w for w in words if w not in shared] and got[i]["n_chars"] == len(got[i]["text"])


def test_repeated_words_like_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice(["a", "bé", "c\u00a0d", "e"]) for _ in range(rng.randrange(0, 60))] for _ in range(50)]
    texts = [" ".join(b) for b in base] + ["x " * 80, "x " * 9]
    split = [t.split() for t in texts]
    holders = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 5):
            holders.setdefault(tuple(w[k : k + 6]), set()).add(i)
    gone = {(i, k + d) for i, w in enumerate(split) for k in range(len(w) - 5) if len(holders[tuple(w[k : k + 6])]) > 1 for d in range(6)}
    want = {i: [x for k, x in enumerate(w) if (i, k) not in gone] for i, w in enumerate(split)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["text"].split() for r in S.without_repeats(df, words=6).collect()}
    assert gone and got == {i: w for i, w in want.items() if i in got}
    assert all(gone >= {(i, k) for k in range(len(split[i]))} and texts[i] for i in set(want) - set(got))


def test_texts_over_a_part(spark, monkeypatch):
    """Texts that are hashed in several parts give what brute force gives."""
    monkeypatch.setattr(S, "PART", 512)
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((30, 900, 3000)))) for _ in range(5)]
    texts[1] = texts[0][-400:] + texts[1]
    parts = {}
    for i, t in enumerate(texts):
        for at, n, anchor, lead in zip(*(c.tolist() for c in S.cells(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), 40, 16)), strict=True):
            parts[i, at] = (n, anchor, lead)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([0] * 5), pa.array([t.encode() for t in texts], pa.binary())], names=["id", "mark", "bytes"])
    windows = {}
    for out in S._emit_cells(iter([batch]), 40, 16):
        for r in out.to_pylist():
            for k in range(r["windows"]):
                windows[r["id"], r["start"] + k] = (r["anchor"], r["lead"] - k)
    want = {(i, at + k): (anchor, lead - k) for (i, at), (n, anchor, lead) in parts.items() for k in range(n)}
    assert windows == want


def test_ids_of_other_types(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(900))
    df = spark.createDataFrame([("a", "head " + t), ("b", "tail " + t), (None, "x")], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(df).collect()} == {"a": 901, "b": 901, None: 0}  # with the space before


def test_words_of_scripts_without_spaces(spark):
    passage = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    df = spark.createDataFrame([(1, "abc " + passage + "甲"), (2, passage + "乙"), (3, passage[:50])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in S.without_repeats(df, length=None, words=51).collect()}
    assert got == {1: "abc 甲", 2: "乙", 3: passage[:50]}
