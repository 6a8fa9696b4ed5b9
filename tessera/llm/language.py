"""Language identification by a byte convolutional network, trained here in numpy.

A text is read as UTF-8 bytes in fixed-length windows. Filters of several widths slide over a window;
each one's largest response over the window goes through a rectifier to a softmax over languages. A
document's probabilities are the mean of its windows', weighed by their bytes.

Weights sit on one-hot bytes, so a filter of width w is w tables of 256 rows and its response the sum
of one row of each: no embedding is needed.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, free_name, learnable_column, stored, worker_cache

#: Labelled rows that training may take, over all languages together, each with its whole text; the bound grows
#: with the number of languages, so that every one has so many.
SAMPLE_ROWS, LEAST_ROWS = 2400, 8
#: Windows that a step of training looks at, and that an epoch draws from each text: long ones count no more.
BATCH, DRAWN = 64, 4
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 12
UNKNOWN = "und"


@dataclass
class Network:
    """tables[w]: (w, 256, filters); out: (filters of all widths + 1, languages)."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    out: np.ndarray



def _fuse(table: np.ndarray) -> list[np.ndarray]:
    """Tables over pairs of bytes: one row to read where there were two; the last may stay single."""
    out = []
    for i in range(0, len(table) - 1, 2):
        out.append((table[i][:, None, :] + table[i + 1][None, :, :]).reshape(65536, -1).astype(np.float32))
    if len(table) % 2:
        out.append(table[-1].astype(np.float32))
    return out


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes of a whole text, the last window filled up with zeros; an empty text has one."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def _responses(network: Network, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of each filter (n, filters) and where it was, for training."""
    values, places = [], []
    for w, table in network.tables.items():
        length = windows.shape[1] - w + 1
        response = sum(table[i][windows[:, i : i + length]] for i in range(w))
        at = response.argmax(axis=1)
        places.append(at)
        values.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0, :])
    return np.concatenate(values, axis=1), places


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 4, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam on windows of labelled texts; languages weigh alike however many texts they have.

    An epoch takes DRAWN windows of each text, anywhere in it (all of a short one).
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    whole = [windows_of(t) for t in texts]
    number = np.array([languages.index(label) for label in labels])

    def drawn() -> tuple[np.ndarray, np.ndarray]:
        """Windows of this epoch; shorter ones too, so that short texts are met in training."""
        xs, ys = [], []
        for rows, y in zip(whole, number, strict=True):
            for i in range(len(rows)) if len(rows) <= DRAWN else rng.integers(0, len(rows), DRAWN):
                row = rows[i]
                if rng.random() < 0.3:
                    row = row.copy()
                    row[rng.integers(8, WINDOW) :] = 0
                xs.append(row)
                ys.append(y)
        return np.array(xs), np.array(ys)

    _, y = drawn()
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weigh = (1 / (share * len(languages))).astype(np.float32)
    shapes = {w: (w, 256, FILTERS) for w in WIDTHS}
    network = Network(
        languages,
        {w: rng.normal(0, 0.1, s).astype(np.float32) for w, s in shapes.items()},
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(languages))).astype(np.float32),
    )
    params = [*network.tables.values(), network.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        x, y = drawn()
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            step += 1
            rows = x[batch]
            raw, places = _responses(network, rows)
            hidden = np.concatenate([np.maximum(raw, 0), np.ones((len(rows), 1), np.float32)], axis=1)
            p = _softmax(hidden @ network.out)
            p[np.arange(len(rows)), y[batch]] -= 1
            p *= weigh[y[batch]][:, None] / len(rows)
            grads = []
            back = (p @ network.out[:-1].T) * (raw > 0)
            for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                grad = np.zeros(shapes[w], np.float32)
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(w):
                    np.add.at(grad[i], (rows[np.arange(len(rows))[:, None], at + i], np.arange(FILTERS)[None, :]), part)
                grads.append(grad)
            grads.append(hidden.T @ p)
            for param, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return network


class Predictor:
    def __init__(self, network: Network):
        self.languages, self.out = network.languages, network.out
        self.fused = {w: _fuse(t) for w, t in network.tables.items()}

    def windows(self, rows: np.ndarray, block: int = 64) -> np.ndarray:
        """Probabilities of each window; block bounds the memory."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            pairs = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            best = []
            for w, tables in self.fused.items():
                length = part.shape[1] - w + 1
                response = tables[0][pairs[:, :length]]
                for i, table in enumerate(tables[1:], 1):
                    index = pairs if len(table) == 65536 else part
                    response += table[index[:, 2 * i : 2 * i + length]]
                best.append(response.max(axis=1))
            hidden = np.maximum(np.concatenate(best, axis=1), 0)
            out[at : at + block] = _softmax(hidden @ self.out[:-1] + self.out[-1])
        return out

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; UNKNOWN and 0 for a text without a letter."""
        kept = [(i, t) for i, t in enumerate(texts) if t and _has_letter(t)]
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows: list[np.ndarray] = []
        owners: list[int] = []
        sums = np.zeros((len(texts), len(self.languages)))

        def flush() -> None:
            if rows:
                stacked = np.concatenate(rows)
                weight = np.maximum((stacked != 0).sum(axis=1), 1)
                np.add.at(sums, np.repeat(owners, [len(r) for r in rows]), self.windows(stacked) * weight[:, None])
                rows.clear()
                owners.clear()

        held = 0
        for i, text in kept:
            found = windows_of(text.encode("utf-8", "replace"))
            for at in range(0, len(found), 4096):
                rows.append(found[at : at + 4096])
                owners.append(i)
                held += len(rows[-1])
                if held >= 4096:
                    flush()
                    held = 0
        flush()
        for i, _ in kept:
            p = sums[i] / sums[i].sum()
            best = int(p.argmax())
            languages[i], scores[i] = self.languages[best], float(min(1.0, p[best]))
        return languages, scores


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(docs: DataFrame, id: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang): a bounded sample of labelled rows that may be learned from, about as many of each language.

    Every language is in it, with LEAST_ROWS rows or all it has, whatever their number. The rows with the
    least hashes of their id are taken, so a run repeats. The share of hashes that holds about as many rows
    as wanted is known for each language before any text is read; twice the bound ends it, in the hashes' order.
    """
    labelled = docs.where(learnable_column(id) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.lit(1)).alias("h"))
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(LEAST_ROWS, rows // max(1, counts.count()))
    bound = (F.lit(-(2.0**63)) + F.least(F.lit(1.0), 2 * F.lit(each) / F.col("n")) * 2.0**64).cast("bigint")
    # a table of languages: Spark broadcasts it while it is small, and splits a common language where it isn't
    near = labelled.join(counts.withColumn("bound", bound), "lang").where(F.col("h") <= F.col("bound"))
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("text", "lang")


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Network | None:
    """Train on sample(); None if no row has a label and a letter. Held-out rows are never read for it."""
    taken = [(r[0].encode("utf-8", "replace"), r[1]) for r in sample(docs, id, text, lang, rows).collect() if r[0] and _has_letter(r[0])]
    taken.sort()
    return train([t for t, _ in taken], [label for _, label in taken]) if taken else None


def predict(docs: DataFrame, network: Network | None, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Append the language of each whole text and its probability.

    Null texts and texts without a letter get "und" and 0, as do all if there is no network. Columns
    stay, rows stay; columns of the two new names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(pickle.dumps(network))
    name = uuid.uuid4().hex
    plain = docs.drop(lang_out, score_out)
    at = plain.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Predictor | None:
            found = pickle.loads(held.value)
            return Predictor(found) if found else None

        predictor = worker_cache("language", name, make)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if predictor is None:
                languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                languages, scores = predictor.batch(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(of, f"{kinds}, `{lang_out}` string, `{score_out}` double")


def keep_known(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows whose text is in a language, with that in column `lang`: what predict() calls "und" goes.

    Columns stay. If no row can be learned from, no text has a language that is known, and only rows
    with a letter stay, as they are.
    """
    network = fit(docs, id, text, lang)
    if network is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    found, score = free_name("_lang_pred", docs), free_name("_lang_score", docs)
    marked = predict(docs, network, text, found, score).where(F.col(found) != UNKNOWN)
    return marked.withColumn(lang, F.col(found)).select(*docs.columns)
