"""Language, quality and neighbours: held-out accuracy, recall, edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language as L
from tessera.llm import neighbours as N
from tessera.llm import quality as Q
from tessera.llm._common import held_out_column

SF = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    ids = [0, 1, 2, 33, 1000, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(held_out_column()).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_language_accuracy(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    network = L.fit(docs)
    got = L.predict(docs, network).where(held_out_column()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    out = L.predict(edge, network)
    rows = out.collect()
    assert len(rows) == edge.count() and {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, 8}
    assert L.predict(edge.limit(0), network).count() == 0
    assert {r["lang_pred"] for r in L.predict(edge, L.fit(edge.limit(0))).collect()} == {"und"}
    kept = L.keep_known(edge)
    assert kept.columns == edge.columns


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        rows = L.windows_of(b"x" * n)
        assert int((rows != 0).sum()) == n and rows.shape[1] == L.WINDOW


def test_fused_tables_change_nothing():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b"], {w: rng.normal(size=(w, 256, L.FILTERS)).astype(np.float32) for w in L.WIDTHS}, rng.normal(size=(L.FILTERS * len(L.WIDTHS) + 1, 2)).astype(np.float32))
    rows = rng.integers(0, 256, (7, L.WINDOW)).astype(np.uint8)
    raw, _ = L._responses(net, rows)
    want = L._softmax(np.concatenate([np.maximum(raw, 0), np.ones((7, 1))], axis=1) @ net.out)
    assert np.allclose(L.Predictor(net).windows(rows), want, atol=1e-4)


def test_quality_accuracy(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    scored = Q.classify(docs, labels).join(labels, "doc_id").where(held_out_column()).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.85 and all(0 <= r["score"] <= 1 for r in scored)
    marks = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, None), (4, 0), (None, 1)], "doc_id bigint, quality int")
    out = Q.classify(edge, marks)
    rows = out.collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert Q.classify(edge.limit(0), marks).count() == 0 and {r["score"] for r in Q.classify(edge, marks.limit(0)).collect()} == {0.5}


def test_word_vectors_are_sums_over_the_corpus(spark):
    docs = spark.createDataFrame([("one two three four",), ("two one",), (None,), ("",)], "text string")
    a, b = Q.word_vectors(docs), Q.word_vectors(docs.repartition(3))
    assert a.shape == (Q.BUCKETS, Q.WIDTH) and np.array_equal(a, b)
    assert Q.pool(["", None], a).tolist() == [[0.0] * (4 * Q.WIDTH)] * 2


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0] * 3), (1005, []), (None, rows[1][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows + odd], "vec_id bigint, embedding array<double>, key string").repartition(4)
    out = N.search(df, F.col("vec_id") % 50 == 0).collect()
    ids = [*range(600), 1004]  # the shorter vector takes part, with zeros at its end
    x = np.vstack([x, [1.0] * 3 + [0.0] * 13])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        near = dict(zip(ids, unit @ unit[q], strict=True))
        order = sorted((i for i in ids if i != q), key=lambda i: (-round(near[i], 12), i))[:5]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(near[v] - s) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(order))
        if 100 <= q < 160:
            assert [v for _, v, _ in got] == [i for i in range(100, 160) if i != q][:5]
    assert hits >= 0.9 * 60
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    assert [(r["query_id"], r["rank"]) for r in N.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert N.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall(spark):
    """At least 0.9 of the true neighbours at both sizes, with the settings of the query."""
    import __spark_entry__ as entry

    for sf in ("sf0.01", "sf0.1"):
        out = entry.queries()["op6_nearest_neighbours"](spark, f"/root/testdata/{sf}").collect()
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
        ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        found = {}
        for r in out:
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = 0
        for q, near in found.items():
            score = unit @ unit[ids == q][0]
            score[ids == q] = -9
            hits += len({v for _, v, _ in near} & set(ids[np.argsort(-score, kind="stable")[:5]].tolist()))
            assert [r for r, _, _ in sorted(near)] == [1, 2, 3, 4, 5] and [s for _, _, s in sorted(near)] == sorted((s for _, _, s in near), reverse=True)
        assert set(found) == set(ids[ids % 50 == 0].tolist()) and hits >= 0.9 * 5 * len(found)


def test_exact_search_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    monkeypatch.setattr(N, "PART", 20)
    out = N.search(df, F.col("vec_id") % 10 == 0, exact=True).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 700, 10):
        near = unit @ unit[q]
        near[q] = -9
        assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-near, kind="stable")[:5].tolist()


def cosines(rows):
    """Exact cosines of all pairs of (id, vector), missing components as zeros, by fractions of floats that are scaled first."""
    from fractions import Fraction

    dims = max(len(v) for _, v in rows)
    whole = {i: [Fraction(c) for c in v] + [Fraction(0)] * (dims - len(v)) for i, v in rows}
    norm = {i: sum(c * c for c in v) for i, v in whole.items()}

    def of(a, b):
        dot = sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
        return float(dot * dot / (norm[a] * norm[b])) ** 0.5 * (1 if dot > 0 else -1)

    return of


def test_huge_tiny_and_shorter_vectors(spark):
    """No score is NaN or lost, whatever the scale; vectors of several lengths all take part."""
    rng = np.random.default_rng(8)
    scales = [1e200, 1e300, 1e-200, 1e-308, 1.0, 3e-320]
    rows = [(i, (rng.normal(size=6) * scales[i % 6]).tolist()) for i in range(60)]
    rows += [(60 + i, rng.normal(size=n).tolist()) for i, n in enumerate([1, 2, 3, 5, 8, 8])] + [(70, []), (71, [0.0, 0.0])]
    rows = [(i, v) for i, v in rows if v is not None]
    out = N.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 2 == 0, exact=True).collect()
    usable = [(i, v) for i, v in rows if any(v)]
    score = cosines(usable)
    found = {q: [r for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q, _ in usable if q % 2 == 0}
    assert len(out) == 5 * len(found)
    for q, near in found.items():
        best = sorted((-score(q, i), i) for i, _ in usable if i != q)[:5]
        assert [r["score"] for r in near] == pytest.approx([-s for s, _ in best], abs=1e-9)


def test_queries_go_on_until_they_have_enough(spark, monkeypatch):
    """A leaf that holds fewer rows than were asked for isn't the end: all candidates come, if there are no more."""
    monkeypatch.setattr(N, "leaves_needed", lambda *a: 1)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for k in (5, 40, 299, 400):
        out = N.search(d, F.col("vec_id") % 100 == 0, k=k, trees=2, leaf=4).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("m")).collect()
        assert {(r["query_id"], r["n"], r["m"]) for r in out} == {(q, min(k, 299), min(k, 299)) for q in (0, 100, 200)}


def test_every_language_is_learned(spark):
    """More languages than the sample has rows: each still gets some."""
    rows = [(i, "".join(chr(97 + (i // 12 * 7 + k) % 26) for k in range(30)), f"l{i // 12:03d}") for i in range(12 * 230)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    taken = L.sample(df, "doc_id", "text", "lang", rows=300).groupBy("lang").count().collect()
    assert len(taken) == 230 and all(1 <= r["count"] <= L.LEAST_ROWS for r in taken)
    held = {r["doc_id"] for r in df.where(held_out_column()).collect()}
    assert len(held) > 0


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "cc", "Dd", "e9"], n)) for n in (3, 50, 7, 0, 31)] + [None]
    import pyarrow as pa

    def sums():
        out = next(iter(Q._gather(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]))))
        return dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))

    table = rng.normal(size=(Q.BUCKETS, Q.WIDTH)).astype(np.float32)
    whole, pooled = sums(), Q.pool(texts, table)
    for block in (4, 8, 13):
        monkeypatch.setattr(Q, "BLOCK", block)
        assert sums() == whole and np.allclose(Q.pool(texts, table), pooled)
