"""Benchmark decontamination: which documents hold a test item, by MinHash containment search.

The shingles of an item, ordered by hash, make its MinHash sketch. A document that holds at least a share
t of an item's q shingles lacks at most q - ceil(t q) of them, so it holds one of the item's
q - ceil(t q) + 1 least. Items are partitioned by size, and each size class takes the sketch that its
largest size needs. So a search for sketch values among a document's hashes misses nothing, whatever
the document's length; it finds candidates, which are verified by exact shingle containment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, free_name, stored, worker_cache

WORDS, SHARE = 5, 0.8
#: Up to so many bytes of items in the driver's count, their sketches and shingles go to all tasks.
BROADCAST_BYTES = 4 << 20

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def shingles_of(text: str | None, words: int = WORDS) -> set[str]:
    """Runs of `words` words, joined by a space; a shorter text is one shingle; without words there is none."""
    found = words_of(text)
    if not found:
        return set()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


class _WordHashes(dict):
    """64-bit hashes by word; cleared when it holds `most`."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(found: list[str], words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each shingle of a list of words; those of a short list all go into one."""
    if not found:
        return np.empty(0, np.uint64)
    hashes = worker_cache("decontaminate", "words", _WordHashes)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(each) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(each))):
        out = out * _ODD + each[i : i + n]
        out ^= out >> np.uint64(29)
    return out


def size_class(q: int) -> int:
    """Items of q shingles share a class with those up to the next power of two."""
    return 1 << max(0, (q - 1).bit_length())


def sketch_size(q: int, share: float) -> int:
    """Least hashes of which one must be found: for the largest item of the class, whose share allows the most gaps."""
    largest = size_class(q)
    return min(q, largest - int(np.ceil(share * largest - 1e-9)) + 1)


ITEMS = "item bigint, size int, sketch array<bigint>, shingles array<string>"


def item_sketches(items: DataFrame, id: str, text: str, words: int, share: float) -> DataFrame:
    """(item, size, sketch, shingles) of each distinct item text; items without words are left out."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, value in zip(frame["item"], frame["text"], strict=True):
                found = words_of(value)
                if not found:
                    continue
                hashes = np.unique(shingle_hashes(found, words))
                distinct = sorted(shingles_of(value, words))
                least = hashes[: sketch_size(len(distinct), share)]
                rows.append((item, len(distinct), least.view(np.int64).tolist(), distinct))
            yield pd.DataFrame(rows, columns=["item", "size", "sketch", "shingles"])

    plain = items.select(F.col(id).cast("bigint").alias("item"), F.col(text).alias("text")).where("item is not null").distinct()
    return plain.mapInPandas(of, ITEMS)


FOUND = "id bigint, item bigint, n_item bigint, n_shared bigint, containment double"


def _verified(doc: int, found: list[str], candidates: list[tuple[int, int, list[str]]], words: int, share: float) -> list[tuple]:
    """Exact containment of each candidate (item, size, shingles) in a document's words."""
    own = {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}
    out = []
    for item, size, shingles in candidates:
        shared = sum(s in own for s in shingles)
        if shared >= share * size - 1e-9:
            out.append((doc, item, size, shared, shared / size))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "item", "n_item", "n_shared", "containment"])


def _search_here(docs: DataFrame, items: DataFrame, words: int, share: float) -> DataFrame:
    """All items go to every task; the caller has checked their size."""
    held = [(r["item"], r["size"], r["sketch"], r["shingles"]) for r in items.collect()]
    pairs = sorted((h, i) for i, (_, _, sketch, _) in enumerate(held) for h in sketch)
    keys = np.array([h for h, _ in pairs], np.int64).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], np.array([i for _, i in pairs], np.int64)[order], held))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = shared.value
        bits = 1 << 20  # most hashes are dismissed by a table of bits
        table = np.zeros(bits, bool)
        table[keys & np.uint64(bits - 1)] = True
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                hashes = shingle_hashes(found, words)
                hashes = np.unique(hashes[table[hashes & np.uint64(bits - 1)]])
                if not len(hashes) or not len(keys):
                    continue
                lo, hi = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
                hit = {int(i) for a, b in zip(lo, hi, strict=True) for i in owners[a:b]}
                if hit:
                    rows += _verified(doc, found, [(held[i][0], held[i][1], held[i][3]) for i in sorted(hit)], words, share)
            if rows:
                yield pa.RecordBatch.from_pandas(_frame(rows).astype({"id": "int64", "item": "int64", "n_item": "int64", "n_shared": "int64"}), preserve_index=False)

    return docs.mapInArrow(of, FOUND)


def _search_shuffled(docs: DataFrame, items: DataFrame, words: int, share: float) -> DataFrame:
    """Items of any number: hashes of documents and sketches meet by a join, then texts and shingles."""

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words_of(x), words)).view(np.int64) for x in texts], dtype=object)

    @F.pandas_udf("bigint")
    def shared(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for text, shingles in zip(texts, wanted, strict=True):
            own = shingles_of(text, words)
            out.append(sum(s in own for s in shingles))
        return pd.Series(out, dtype="int64")

    keyed = docs.select("id", F.xxhash64("text").alias("mark"), F.explode(hashes("text")).alias("hash"))
    sketches = items.select("item", F.explode("sketch").alias("hash"))
    candidates = keyed.join(sketches, "hash").select("id", "mark", "item").distinct()
    texts = docs.withColumn("mark", F.xxhash64("text"))
    held = candidates.join(items.select("item", "size", "shingles"), "item").join(texts, ["id", "mark"])
    counted = held.select("id", "item", F.col("size").cast("bigint").alias("n_item"), shared("text", "shingles").alias("n_shared"))
    return counted.where(F.col("n_shared") >= share * F.col("n_item") - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    share: float = SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, item_id, n_item_shingles, n_shared, containment) of documents that hold at least `share` of an item.

    Words are lower-cased runs of letters and digits; shingles are sets of runs of `words` of them; a
    text with fewer words is one shingle, and one without words holds nothing and is held by nothing.
    Rows without an id are left out; equal rows of (id, text) count once; rows of one id with different
    texts are searched each. Items up to broadcast_bytes go to all tasks; more are joined by hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text))), F.lit(0))).first()[0]
    sketches = stored(item_sketches(items, item_id, item_text, words, share), "items")
    if size <= broadcast_bytes:
        found = _search_here(plain, sketches, words, share)
    else:
        found = _search_shuffled(plain, sketches, words, share)
    found = found.groupBy("id", "item", "n_item", "n_shared").agg(F.max("containment").alias("containment"))
    return found.select(
        F.col("id").alias(id), F.col("item").alias(item_id), F.col("n_item").alias("n_item_shingles"), "n_shared", "containment"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose text holds no item; columns stay.

    Rows are judged by their text, whether their ids are unique, repeated or null.
    """
    mark, leak = free_name("_mark", docs), free_name("_leak", docs)
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = contaminated(marked.select(mark, text), items, mark, text, **options)
    found = stored(found.select(F.col(mark).alias(leak)).distinct(), "leaks")
    return marked.join(found, marked[mark] == found[leak], "left_anti").select(*docs.columns)
