"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates, from that of its n-gram down to that of
the token alone and an even share for each known word and one unknown. Contexts are put into buckets by how often
they occur in training, and each bucket has its own weights. Weights are learned by expectation-maximisation on
held-out counts: each training text is looked at with its own counts taken out of the totals (deleted), so the
whole training set serves both ends.

How it runs: texts become chunks of about CHUNK tokens, written once. Each chunk sends each distinct n-gram's
64-bit hash with the chunk's count to the bucket of that hash; the bucket adds up and sends totals back. A hot word
is one entry a chunk, so no bucket is hot, and the number of buckets follows the number of entries. A chunk that has
its totals gives cells of equal estimates for the weights, and later the scores of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._common import Scratch, bounded_batches, worker_cache

#: Length of the longest n-grams; tokens of a chunk; bytes hashed together; entries of a bucket.
ORDER, CHUNK, BLOCK, ENTRIES = 2, 1 << 19, 1 << 20, 1 << 20
#: Cells an octave of the estimates that weights are learned from, buckets of contexts per order, rounds and their end.
GRAIN, BINS, ROUNDS, SETTLED = 4, 64, 200, 1e-7
#: Held-out tokens that the mixture of all buckets counts for in each bucket, so that none is without weights.
PRIOR = 1.0

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(29).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_WRAP = 2**64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


START, END = _mix(np.array([1, 2], np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""

    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, _WRAP))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of each word of at most 2 * BLOCK bytes: differences of one running sum, so no word is handled alone."""
    powers, inverse = worker_cache("lm", 2 * BLOCK + 1, lambda: _powers(2 * BLOCK + 1))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
    begin, end = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    return begin, _mix((sums[end] - sums[begin]) * inverse[begin])


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, which white space may precede, a block at a time."""
    powers, _ = worker_cache("lm", 2 * BLOCK + 1, lambda: _powers(2 * BLOCK + 1))
    data, total = data[int(_SPACE[data[0]]) :], 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += int((_VALUES[part] * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, _WRAP)
    return _mix(np.array([total % _WRAP], np.uint64))


def _cut(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK bytes that end before white space; a longer word is a range of its own."""
    view, at = np.frombuffer(data, np.uint8), 0
    while len(data) - at > BLOCK:
        spaces = np.flatnonzero(_SPACE[view[at : at + BLOCK]])
        stop = at + int(spaces[-1]) if len(spaces) else at
        if stop == at:  # no white space but perhaps the first byte: on to the next
            stop += 1
            while stop < len(data):
                spaces = np.flatnonzero(_SPACE[view[stop : stop + BLOCK]])
                stop = stop + int(spaces[0]) if len(spaces) else min(stop + BLOCK, len(data))
                if len(spaces):
                    break
        yield at, stop
        at = stop
        if at == len(data):
            return
    yield at, len(data)


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, the lowest first: the high planes are mostly zero and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


CHUNKS = "chunk bigint, learned bigint, n_entries bigint, words binary, seq binary, lengths array<int>, opens array<boolean>, learn array<boolean>, held array<boolean>, row array<bigint>, id array<{id}>"


class _Chunks:
    """Collects the token streams of a partition's texts into chunks."""

    def __init__(self, order: int, schema: pa.Schema):
        self.order, self.schema, self.part, self.number = order, schema, TaskContext.get().partitionId(), 0
        self.streams, self.facts, self.tokens = [], [], 0
        self.before, self.opening = np.full(order - 1, START), False

    def add(self, words: np.ndarray, opens: bool, ends: bool, fact: tuple) -> Iterator[pa.RecordBatch]:
        """Words of a text, or of a part of one; fact: (learn, held, row, id)."""
        opens, self.opening = opens or self.opening, False
        if not ends and not len(words):
            self.opening = opens
            return
        pads = np.full(self.order - 1, START) if opens else self.before
        stream = np.concatenate((pads, words, np.array([END][: int(ends)], np.uint64)))
        self.before = stream[len(stream) - self.order + 1 :]
        self.streams.append(stream)
        self.facts.append((len(stream), opens, *fact))
        self.tokens += len(stream) - self.order + 1
        if self.tokens >= CHUNK:
            yield self.chunk()

    def chunk(self) -> pa.RecordBatch:
        words, seq = np.unique(np.concatenate(self.streams), return_inverse=True)
        lengths, opens, learn, held, row, id = zip(*self.facts, strict=True)
        learned = sum(n - self.order + 1 for n, use in zip(lengths, learn, strict=True) if use)
        entries = len(words) + self.tokens * (self.order - 1)
        values = [(self.part << 32) + self.number, learned, entries, words.tobytes(), _packed(seq.astype(np.uint32)), lengths, opens, learn, held, row, id]
        self.streams, self.facts, self.tokens, self.number = [], [], 0, self.number + 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)


def _chunked(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    chunks, pieces, size, number = None, [], 0, 0

    def hashed() -> Iterator[pa.RecordBatch]:
        begin, h = _hashed(np.frombuffer(b" ".join(p[0] for p in pieces), np.uint8))
        starts = np.searchsorted(begin, np.cumsum([0] + [len(p[0]) + 1 for p in pieces]))
        for (_, opens, ends, fact), a, b in zip(pieces, starts, starts[1:], strict=False):
            yield from chunks.add(h[a:b], opens, ends, fact)

    for batch in batches:
        if chunks is None:
            kinds = [("chunk", pa.int64()), ("learned", pa.int64()), ("n_entries", pa.int64()), ("words", pa.binary()), ("seq", pa.binary()), ("lengths", pa.list_(pa.int32()))]
            kinds += [(c, pa.list_(pa.bool_())) for c in ("opens", "learn", "held")] + [("row", pa.list_(pa.int64())), ("id", pa.list_(batch.schema.field(0).type))]
            chunks = _Chunks(order, pa.schema(kinds))
        for id, text, learn, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, fact = (text or "").encode(), (learn, held, (chunks.part << 32) + number, id)
            number += 1
            for at, stop in _cut(data):
                piece = (data[at:stop] if stop - at < len(data) else data, at == 0, stop == len(data), fact)
                if size and size + stop - at > BLOCK:
                    yield from hashed()
                    pieces, size = [], 0
                if stop - at > BLOCK:
                    yield from chunks.add(_long_word(np.frombuffer(piece[0], np.uint8)), *piece[1:])
                else:
                    pieces.append(piece)
                    size += stop - at + 1
    if pieces:
        yield from hashed()
    if chunks and chunks.tokens:
        yield chunks.chunk()


class _Grams:
    """A chunk's n-grams: of each order the number at each place, and the distinct hashes in rising order.

    Streams begin with order - 1 tokens of context. Places whose n-gram would reach into the stream before have
    number -1. `counted` marks tokens, `opening` the last start mark before a text, which counts as a context.
    """

    def __init__(self, chunk: dict, order: int):
        self.words, self.seq = np.frombuffer(chunk["words"], np.uint64), _unpacked(chunk["seq"], np.uint32).astype(np.int64)
        lengths = np.array(chunk["lengths"], np.int64)
        begin = np.cumsum(lengths) - lengths
        self.stream = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(self.seq)) - begin[self.stream]
        self.learn = np.array(chunk["learn"], bool)[self.stream]
        self.counted = offset >= order - 1
        self.opening = (offset == order - 2) & np.array(chunk["opens"], bool)[self.stream]
        self.at, self.keys = [self.seq], [self.words]
        for o in range(2, order + 1):
            inside = np.flatnonzero(offset >= o - 1)
            codes, number = np.unique(self.at[-1][inside - 1] * len(self.words) + self.seq[inside], return_inverse=True)
            keys = _mix(self.keys[-1][codes // len(self.words)] * np.uint64(_BASE) + self.words[codes % len(self.words)] + np.uint64(o))
            rising = np.argsort(keys, kind="stable")
            rank = np.empty(len(keys), np.int64)
            rank[rising] = np.arange(len(keys))
            at = np.full(len(self.seq), -1)
            at[inside] = rank[number]
            self.at.append(at)
            self.keys.append(keys[rising])

    def learned(self, o: int) -> np.ndarray:
        """Of each distinct n-gram of order o + 1, its occurrences in training texts."""
        used = self.learn & (self.counted | self.opening) & (self.at[o] >= 0)
        return np.bincount(self.at[o][used], minlength=len(self.keys[o]))

    def own(self, o: int) -> np.ndarray:
        """At each place, how often its n-gram occurs in its own text, or the part of it that lies in this chunk."""
        used = np.flatnonzero((self.counted | self.opening) & (self.at[o] >= 0))
        _, number, times = np.unique(self.stream[used] * len(self.keys[o]) + self.at[o][used], return_inverse=True, return_counts=True)
        out = np.zeros(len(self.seq), np.int64)
        out[used] = times[number]
        return out


def _sent(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, chunk, keys, times) of each chunk: its distinct hashes by ranges."""
    bounds = np.array([-(-(_WRAP * b) // buckets) for b in range(1, buckets)], np.uint64)
    for batch in batches:
        for chunk in batch.to_pylist():
            grams = _Grams(chunk, order)
            for o, keys in enumerate(grams.keys):
                times, cuts = grams.learned(o), np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
                spots = [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o] * len(spots), pa.int32()),
                        pa.array([b for b, *_ in spots], pa.int32()),
                        pa.array([chunk["chunk"]] * len(spots), pa.int64()),
                        pa.array([keys[x:y].tobytes() for _, x, y in spots], pa.binary()),
                        pa.array([_packed(times[x:y]) for _, x, y in spots], pa.binary()),
                    ],
                    names=["kind", "bucket", "chunk", "keys", "times"],
                )


def _added(group: pa.Table) -> pa.Table:
    """Totals of a bucket's hashes, sent back to each chunk; `known` counts the bucket's words of training, once."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["keys"]]
    keys, number = np.unique(np.concatenate(parts), return_inverse=True)
    times = np.concatenate([_unpacked(x.as_buffer(), np.int64) for x in group["times"]])
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, number, times)
    known = int(((totals > 0) & (keys != START)).sum()) if group["kind"][0].as_py() == 0 else 0
    back = np.split(totals[number], np.cumsum([len(p) for p in parts])[:-1])
    return pa.table(
        [group["kind"], group["bucket"], group["chunk"], pa.array([_packed(b) for b in back], pa.binary()), pa.array([known] + [0] * (len(back) - 1), pa.int64())],
        names=["kind", "bucket", "chunk", "totals", "known"],
    )


def _bucket(contexts: list[np.ndarray], n: int) -> np.ndarray:
    """The bucket of each of n tokens by the totals of its contexts, the shortest first: of the longest one seen, its order and its octave."""
    out = np.zeros(n, np.int64)
    for o, seen in enumerate(contexts):
        out = np.where(seen > 0, o * BINS + np.frexp(seen.astype(float))[1], out)
    return out


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], total) -> list[np.ndarray]:
    """Maximum-likelihood estimates by order, the lowest first; 0 where the context wasn't seen."""
    out = [counts[0] / np.maximum(total, 1)]
    return out + [np.where(c > 0, np.minimum(n / np.maximum(c, 1), 1.0), 0.0) for n, c in zip(counts[1:], contexts, strict=True)]


class _Counted:
    """A chunk and the totals of its n-grams: of each order, at each place."""

    def __init__(self, left: pa.Table, right: pa.Table, order: int):
        self.chunk = left.to_pylist()[0]
        self.grams = _Grams(self.chunk, order)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = right["kind"].to_numpy()
        totals = [np.concatenate([_unpacked(x.as_buffer(), np.int64) for x in right["totals"].filter(pa.array(kinds == o))]) for o in range(order)]
        self.placed = [np.where(at >= 0, t[at], 0) for at, t in zip(self.grams.at, totals, strict=True)]


def _cells(c: _Counted, learned: int) -> pa.Table:
    """Held-out estimates of a chunk's training tokens, their own texts' counts taken out, by cells."""
    use = np.flatnonzero(c.grams.counted & c.grams.learn)
    rest = [p - c.grams.own(o) for o, p in enumerate(c.placed)]
    contexts = [np.maximum(r[use - 1], 0) for r in rest[:-1]]
    text = c.grams.stream[use]
    f = _estimates([r[use] for r in rest], contexts, learned - np.bincount(text)[text] if len(use) else learned)
    code = _bucket(contexts, len(use))
    for e in f:
        with np.errstate(divide="ignore"):
            code = code * 256 + np.where(e > 0, np.clip(1 + np.rint(-np.log2(e) * GRAIN), 1, 255), 0).astype(np.int64)
    code, number, n = np.unique(code, return_inverse=True, return_counts=True)
    sums = [np.bincount(number, weights=e, minlength=len(code)) for e in f]
    return pa.table([pa.array(code), pa.array(n), *(pa.array(x, pa.float64()) for x in sums)], names=["code", "n", *(f"s{o}" for o in range(len(f)))])


def _scores(c: _Counted, learned: int, known: int, whole: np.ndarray, by_bucket: np.ndarray, id_type: pa.DataType) -> pa.Table:
    """Scores of a chunk's texts, or of the parts of them that lie in it."""
    token, chunk = np.flatnonzero(c.grams.counted), c.chunk
    counts, contexts, text = [p[token] for p in c.placed], [p[token - 1] for p in c.placed[:-1]], c.grams.stream[token]
    bucket = _bucket(contexts, len(token))
    mixed = np.where((bucket < len(by_bucket))[:, None], by_bucket[np.minimum(bucket, len(by_bucket) - 1)], whole)
    p = mixed[:, 0] / (known + 1)
    for o, f in enumerate(_estimates(counts, contexts, learned), 1):
        p = p + mixed[:, o] * f
    add = lambda x: np.bincount(text, weights=x, minlength=len(chunk["lengths"]))
    base = np.log10((counts[0] + 0.5) / (learned + 0.5 * (known + 1)))
    sizes = [np.bincount(t, minlength=len(chunk["lengths"])) for t in (text, text[counts[0] > 0])]
    return pa.table(
        [pa.array(chunk["row"], pa.int64()), pa.array(chunk["id"], id_type), pa.array(chunk["held"], pa.bool_()), *map(pa.array, (*sizes, add(base), add(np.log10(p))))],
        names=["row", "id", "held", "n_tokens", "n_known", "base_score", "score"],
    )


def weights(bucket: np.ndarray, n: np.ndarray, estimates: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the whole, weights by bucket) that make held-out tokens likeliest, by expectation-maximisation.

    estimates (cells, components); n tokens in each cell. A bucket without tokens has the weights of the whole.
    """

    def climb(number: np.ndarray, size: int, pull: np.ndarray) -> np.ndarray:
        held = np.tile(pull, (size, 1))
        for _ in range(ROUNDS):
            share = held[number] * estimates
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            new = np.stack([np.bincount(number, weights=s, minlength=size) for s in share.T], axis=1) + prior * pull
            new /= new.sum(axis=1, keepdims=True)
            if np.abs(new - held).max() < SETTLED:
                return new
            held = new
        return held

    parts = estimates.shape[1]
    whole = climb(np.zeros(len(bucket), np.int64), 1, np.full(parts, 1 / parts))[0]
    return whole, climb(bucket, int(bucket.max()) + 1 if len(bucket) else 1, whole)


def _totals(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(kind, bucket, chunk, totals, known): what the buckets send back."""
    sent = chunks.mapInArrow(lambda b: _sent(b, order, buckets), "kind int, bucket int, chunk bigint, keys binary, times binary")
    return sent.groupBy("kind", "bucket").applyInArrow(_added, "kind int, bucket int, chunk bigint, totals binary, known bigint")


def _with_totals(chunks: DataFrame, added: DataFrame, order: int, of, schema: str) -> DataFrame:
    """What `of` makes of each chunk with its totals."""
    return chunks.groupBy("chunk").cogroup(added.drop("known").groupBy("chunk")).applyInArrow(lambda a, b: of(_Counted(a, b, order)), schema)


def score(docs: DataFrame, learn: Column, held: Column, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learn, held: conditions on docs; the rows that are learned from, and what held_out says. Words are the runs
    without ASCII white space, A to Z as a to z, and each text has one end after them, a token too. score is the
    log10 probability of the text, base_score that of single tokens with half a count added; n_known tokens occur in
    training, which has train_tokens.

    Null texts count as empty and have the end alone. Repeated rows are texts of their own. Conditions that are null
    count as false, so rows without an id are scored and not learned from where the condition reads the id. An empty
    table gives an empty result; without training texts the mixture is even. Words and n-grams are told apart by
    64-bit hashes. A text that spans chunks is taken out of the totals a part at a time when weights are learned;
    its score is that of the whole. Estimates enter the weights as means of cells of a quarter octave.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bounded_batches(spark)
    kind = docs.schema[id].dataType.simpleString()
    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held, F.lit(False)).alias("held"))
    chunks = scratch.stored(given.mapInArrow(lambda b: _chunked(b, order), CHUNKS.format(id=kind)), "chunks")
    learned, entries = chunks.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.coalesce(F.sum("n_entries"), F.lit(0))).first()
    buckets = max(16, math.ceil(entries / ENTRIES))
    bounded_batches(spark, 4)
    added = scratch.stored(_totals(chunks, order, buckets), "totals")
    known = added.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]

    sums = [f"s{o}" for o in range(order)]
    cells = _with_totals(chunks, added, order, lambda c: _cells(c, learned), "code bigint, n bigint, " + ", ".join(f"{x} double" for x in sums))
    cells = scratch.stored(cells.groupBy("code").agg(*[F.sum(x).alias(x) for x in ("n", *sums)]), "cells").toArrow()
    n = cells["n"].to_numpy()
    even = np.full(len(n), 1 / (known + 1))
    whole, by_bucket = weights(cells["code"].to_numpy() >> (8 * order), n, np.stack([even, *(cells[x].to_numpy() / n for x in sums)], axis=1))

    id_type = to_arrow_type(docs.schema[id].dataType)
    told = f"row bigint, id {kind}, held boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    parts = _with_totals(chunks, added, order, lambda c: _scores(c, learned, known, whole, by_bucket, id_type), told)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = parts.groupBy("row").agg(F.first("id").alias(id), F.first("held").alias("held_out"), *sums)
    out = out.select(id, "held_out", "n_tokens", "n_known", F.lit(learned).cast("bigint").alias("train_tokens"), "base_score", "score")
    return scratch.result(out, "scores")
