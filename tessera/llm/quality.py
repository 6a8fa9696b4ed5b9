"""Document quality: random-indexing word vectors, pooled, scored by a two-layer network.

Random indexing gives every word a fixed sparse vector of signs; a word's vector is the sum of those of
its neighbours over the whole corpus. Words live in a fixed number of hash buckets, so the table of
vectors has a fixed size. Besides the word itself, its shape (case, digits, marks around it) is a
second word at the same place. A document is the mean and the spread of its words' vectors.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, hash_bound, learnable_column, worker_cache

#: Hash buckets of words, the first SHAPES of them for shapes; width of a vector; signs of an index vector; neighbours on each side.
BUCKETS, SHAPES, WIDTH, SIGNS, REACH = 8192, 512, 32, 2, 2
#: Labelled rows that training may take.
SAMPLE_ROWS = 4000
#: Words that are handled at once.
BLOCK = 200_000
THRESHOLD = 0.7


def _index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS, SIGNS) of the index vectors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, SIGNS)), rng.choice([-1, 1], (BUCKETS, SIGNS))


class _Words(dict):
    """Word bucket and shape bucket by word, as word * BUCKETS + shape."""

    def __missing__(self, word: str) -> int:
        core = word.strip("".join({c for c in word if not c.isalnum()}))
        before, _, after = word.partition(core) if core else (word, "", "")
        case = "X" if len(core) > 1 and core.isupper() else "x" if core.islower() else "Xx" if core[:1].isupper() else "?"
        digits = any(map(str.isdigit, core))
        shape = f"{before[:4]}|{case}{'9' * digits}{'_' * (not core.isalnum())}|{after[:4]}"
        packed = (SHAPES + xxhash.xxh3_64_intdigest(core.lower()) % (BUCKETS - SHAPES)) * BUCKETS + xxhash.xxh3_64_intdigest(shape) % SHAPES
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, word bucket, shape bucket, repeated) of all words of texts, about BLOCK words at a time.

    A text that goes on in the next block starts there with its last REACH words again, so that
    neighbours meet; the first `repeated` words of a block are such.
    """
    known = worker_cache("quality", "words", _Words)
    rows, found, size, again = [], [], 0, 0
    for i, text in enumerate(texts):
        words = (text or "").split()
        for at in range(0, len(words), BLOCK):
            again = REACH if at else again
            part = words[max(0, at - REACH) : at + BLOCK]
            found.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
            rows.append(np.full(len(part), i))
            size += len(part)
            if size >= BLOCK:
                packed = np.concatenate(found)
                yield np.concatenate(rows), packed // BUCKETS, packed % BUCKETS, again
                rows, found, size, again = [], [], 0, 0
    if size:
        packed = np.concatenate(found)
        yield np.concatenate(rows), packed // BUCKETS, packed % BUCKETS, again


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket, over a partition's texts."""
    places, signs = _index_vectors()
    total = np.zeros(BUCKETS * WIDTH)
    for batch in batches:
        for rows, word, shape, again in _blocks(batch.column(0).to_pylist()):
            for step in range(1, REACH + 1):
                near = np.flatnonzero(rows[step:] == rows[:-step])
                near = near[near + step >= again]
                for left, right in ((near, near + step), (near + step, near)):
                    for target in (word[left], shape[left]):
                        for context in (word[right], shape[right]):
                            for k in range(SIGNS):
                                total += np.bincount(target * WIDTH + places[context, k], weights=signs[context, k], minlength=BUCKETS * WIDTH)
    sums = total.reshape(BUCKETS, WIDTH).astype(np.int64)
    used = np.flatnonzero(sums.any(axis=1))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * WIDTH), pa.array(sums[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), vectors], names=["bucket", "v"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, WIDTH) unit vectors from all texts of docs. Sums are integers, so the order of tasks doesn't matter."""
    bounded_batches(docs.sparkSession)
    parts = docs.select(F.col(text)).mapInArrow(_gather, "bucket int, v array<bigint>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(WIDTH)]).alias("v"))
    table = np.zeros((BUCKETS, WIDTH))
    for row in sums.collect():  # BUCKETS rows at most
        table[row["bucket"]] = row["v"]
    used = table.any(axis=1)
    if used.any():
        table[used] -= (table[used] / np.abs(table[used]).sum(axis=1, keepdims=True)).mean(axis=0) * np.abs(table[used]).sum(axis=1, keepdims=True)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norms > 0, norms, 1)).astype(np.float32)


def pool(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """(texts, 4 * WIDTH): mean and spread of word vectors, then of shape vectors; zeros for a text without words."""
    counts = np.zeros(len(texts))
    sums = np.zeros((len(texts), 4 * WIDTH))
    table = table.astype(np.float64)  # sums of single precision would depend on the block
    for rows, word, shape, again in _blocks(texts):
        rows, word, shape = rows[again:], word[again:], shape[again:]
        begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        at = rows[begin]
        counts[at] += np.diff(np.append(begin, len(rows)))
        for k, bucket in enumerate((word, shape)):
            vectors = table[bucket]
            sums[at, 2 * k * WIDTH : (2 * k + 1) * WIDTH] += np.add.reduceat(vectors, begin, axis=0)
            sums[at, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] += np.add.reduceat(vectors * vectors, begin, axis=0)
    out = sums / np.maximum(counts, 1)[:, None]
    for k in (0, 2):
        mean, square = out[:, k * WIDTH : (k + 1) * WIDTH], out[:, (k + 1) * WIDTH : (k + 2) * WIDTH]
        out[:, (k + 1) * WIDTH : (k + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, rate: float = 0.005, decay: float = 1e-3, seed: int = 3) -> Scorer:
    """Fit on four fifths by Adam, then the temperature on the rest, by the least log loss."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5] if len(x) >= 20 else order
    used = order[len(x) // 5 :] if len(x) >= 20 else order
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-4
    share = float(np.clip(y[used].mean(), 0.01, 0.99))
    s = Scorer(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))), 1.0)
    z = (x - mean) / scale
    params = [s.w1, s.b1, s.w2, np.array([s.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            step += 1
            h = np.tanh(z[batch] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[batch]) / len(batch)
            back = g[:, None] * params[2][None, :] * (1 - h * h)
            grads = [z[batch].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            for param, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s.b2 = float(params[3][0])
    logits = s.logits(x[held])
    tries = np.exp(np.linspace(np.log(0.3), np.log(10), 80))
    s.temperature = float(min(tries, key=lambda t: _loss(logits / t, y[held])))
    return s


def _features(docs: DataFrame, text: str, table: np.ndarray, more: list[str]) -> DataFrame:
    """Keep columns `more` and pool each text into column x."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def pooled(texts: pd.Series) -> pd.Series:
        return pd.Series(list(pool(texts.tolist(), shared.value)), dtype=object)

    return docs.select(*more, pooled(F.col(text)).alias("x"))


def sample_labels(labels: DataFrame, id: str, label: str, rows: int) -> DataFrame:
    """(id, y) of at most 2 * rows labelled ids that may be learned from, about `rows`, by a hash of the id.

    An id with several labels has the least of them.
    """
    order = F.xxhash64(F.col(id), F.lit(2))
    usable = labels.where(learnable_column(id) & F.col(label).isNotNull()).groupBy(id).agg(F.min(label).cast("double").alias("y"))
    n = usable.count()
    # the hash leaves about `rows`; should it be skewed, its least values stay, not those that come first
    return usable.where(order <= hash_bound(rows / max(n, 1))).orderBy(order).limit(2 * rows)


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Scorer | None:
    """Train on a bounded sample of labelled rows; None if there is none."""
    chosen = sample_labels(labels.select(id, label), id, label, rows)
    joined = docs.select(id, text).join(F.broadcast(chosen), id)  # 2 * rows ids at most
    # an id of several texts gives one of them
    one = F.min_by(F.struct("x"), F.xxhash64("x")).alias("one")
    taken = _features(joined, text, table, [id, "y"]).groupBy(id, "y").agg(one).select("y", "one.x").collect()
    if not taken:
        return None
    taken.sort(key=lambda r: (r["y"], r["x"]))
    return train(np.array([r["x"] for r in taken]), np.array([r["y"] for r in taken]))


def score(docs: DataFrame, table: np.ndarray, scorer: Scorer | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the calibrated probability that a whole text is good; 0.5 if there is no scorer.

    Null and empty texts pool to zeros and get the network's score for that. Rows and columns stay; a
    column named `out` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, name = spark.sparkContext.broadcast(pickle.dumps((table, scorer))), uuid.uuid4().hex

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        table, scorer = worker_cache("quality", name, lambda: pickle.loads(shared.value))
        if scorer is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(scorer.scores(pool(texts.tolist(), table)))

    return docs.withColumn(out, of(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on). Vectors come from all texts, labels from learnable rows.

    Every row stays, repeated ones too; null and empty texts get the network's score for no words. Columns
    named score and predicted are replaced. Of an id's several labels the least counts, of its texts one.
    Without any label all scores are 0.5; an empty table stays empty.
    """
    table = word_vectors(docs, text)
    scored = score(docs, table, fit(docs, labels, table, id, text, label), text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


