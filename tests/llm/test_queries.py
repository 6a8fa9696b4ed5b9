"""The queries as the driver calls them, on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import bpe, decontaminate, language
from tessera.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_html_extraction", "op4_benchmark_decontamination", "op8_chat_formatting", "op9_warc"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{x}"' for x in sorted(df.columns))
    want = c.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows) and set(docs.columns) <= set(out.columns)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for i in items for r in rows)


def _documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})


def _packed(reference, text):
    ids = reference.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def _classes(texts):
    """The least id of each document's class, by comparing all pairs."""
    ids = sorted(texts)
    fps = {i: fingerprint(texts[i]) for i in ids}
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, fps


def test_op1_and_op7_columns(spark):
    for name, last in (("op1_quality_classifier", "predicted"), ("op7_language_id", "lang_pred")):
        rows = entry.queries()[name](spark, SF).collect()
        assert {r["doc_id"] for r in rows} == set(_documents(spark)) and len(rows) == len(_documents(spark))
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
            assert last == "lang_pred" or r["predicted"] == int(r["score"] >= 0.7)


def test_op2_is_tiktoken(spark):
    texts, reference = _documents(spark), _reference()
    for r in entry.queries()["op2_byte_level_bpe"](spark, SF).collect():
        packed = _packed(reference, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op5_is_brute_force(spark):
    texts = {i: t.encode() for i, t in _documents(spark).items()}
    places = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    rows = entry.queries()["op5_suffix_array_dedup"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_removed"] for r in rows)
    for r in rows:
        t = texts[r["doc_id"]]
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if places[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"x" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), len(t) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["text"] == kept.decode(errors="replace")


def test_op10_is_all_pairs(spark):
    least, fps = _classes(_documents(spark))
    rows = entry.queries()["op10_simhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", least[i]) for i in least} and len(rows) == len(least)


def test_pipeline_is_brute_force(spark):
    """All stages in plain Python; the network alone is that of the operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predictor = language.Predictor(language.fit(docs))
    texts = _documents(spark)
    found, _ = predictor.batch([texts[i] for i in texts])
    lang = {i: name for i, name in zip(texts, found, strict=True) if name != "und"}
    texts = {i: texts[i] for i in lang}
    least, _ = _classes(texts)
    texts = {i: t for i, t in texts.items() if least[i] == i}
    holders = {}
    split = {i: [m.span() for m in re.finditer(r"\S+", t)] for i, t in texts.items()}
    runs = {i: [tuple(texts[i][a:b] for a, b in s[k : k + 51]) for k in range(len(s) - 50)] for i, s in split.items()}
    for i, r in runs.items():
        for x in r:
            holders.setdefault(x, set()).add(i)
    cut = {}
    for i, t in texts.items():
        keep = [True] * len(t)
        for k, x in enumerate(runs[i]):
            if len(holders[x]) > 1:
                for at in range(split[i][k][0], split[i][k + 50][1]):
                    keep[at] = False
        cut[i] = "".join(c for c, z in zip(t, keep, strict=True) if z)
    texts = {i: t for i, t in cut.items() if t}
    items = [decontaminate.shingles_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingles = {i: decontaminate.shingles_of(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not any(q and len(q & shingles[i]) >= 0.8 * len(q) for q in items)}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    reference = _reference()
    assert set(rows) == set(texts)
    for i, t in texts.items():
        assert (rows[i]["text"], rows[i]["lang"], rows[i]["n_chars"], bytes(rows[i]["ids"]), rows[i]["round_trip"]) == (t, lang[i], len(t), _packed(reference, t), True)


def test_stages_with_clashing_columns(spark, edge):
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_repeats):
        for rows in (edge, edge.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == edge.columns and out.count() <= rows.count()
    assert corpus_pipeline.drop_benchmark(spark, edge, SF).columns == edge.columns
    out = corpus_pipeline.encode_tokens(spark, edge.withColumn("round_trip", edge["v"]), SF)
    assert set(out.columns) == {*edge.columns, "n_tokens", "round_trip"} and out.count() == edge.count()
