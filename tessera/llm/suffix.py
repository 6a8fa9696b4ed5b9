"""Exact removal of byte strings that occur more than once in a corpus, by suffix sorting.

A suffix array of the corpus would not fit one task, so the corpus is cut so that equal strings meet:

1. Every window of `length` bytes chooses an anchor, the gram of `gram` bytes in it with the least
   hash, leftmost first. Equal windows choose equal anchors. Neighbouring windows with one anchor form
   a cell: (anchor, first window, number of windows). Only hashes and places of cells are shuffled.
2. Cells whose anchor occurs once hold no repeat. Cells with equal bytes (128-bit hash) hold nothing
   else, and stand for each other from here on.
3. What is left, a cell of each kind for anchors with several kinds, is grouped by anchor. A task joins
   many groups into one text, sorts its suffixes in two stages and compares neighbours.
4. Groups too large for a task are cut: windows are dealt into blocks by their place relative to the
   anchor, and the bytes that all windows of a block share make its new group. Blocks shrink to a
   quarter each time, down to single windows, whose group is one kind of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm._common import Scratch, bounded_batches, free_name, partitions, worker_cache

LENGTH, GRAM = 400, 100
#: Bytes of text that are hashed at once; longer texts go through in overlapping parts.
PART = 1 << 20
#: Kinds of cells in a group that one task takes; larger groups are cut.
GROUP = 256
#: Bytes that one suffix array spans.
SPAN = 1 << 18
#: Words of the shortest passage that counts across documents: over 50.
RUN_WORDS = 51
WORD_BYTES = 4

#: A word is what white space parts; characters of scripts that are written without it are words each.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\s{_UNSPACED}]+|[{_UNSPACED}]")

_FACTOR = 0x9E3779B97F4A7C15 | 1


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2 ** 64."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[:], down[:] = _FACTOR, pow(_FACTOR, -1, 1 << 64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A well mixed 64-bit hash of each run of `gram` bytes."""
    n = len(data)
    up, down = _powers(max(PART * 2, 1 << (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = (sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: of blocks, running minima from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def cells(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor hash, bytes from first window to anchor) of cells.

    data holds texts end to end; ends has the place after each.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = window_minima((hashes & ~low) | place, length - gram + 1)
    anchor = (least & low).astype(np.int64)
    windows = np.arange(len(anchor))
    of = np.searchsorted(ends, windows, side="right")
    whole = windows + length <= ends[of]
    windows, anchor, of = windows[whole], anchor[whole], of[whole]
    if not len(windows):
        return (windows,) * 4
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    return windows[first], count, hashes[anchor[first]].view(np.int64), anchor[first] - windows[first]


CELLS = "anchor bigint, kind binary, id bigint, mark bigint, start bigint, windows int, lead int"


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[tuple[int, int]], bytes, list[int]]]:
    """Runs of about PART bytes: (row, place in its text) of each piece, the bytes, and where pieces end."""
    rows, pieces, ends, size = [], [], [], 0
    for row, text in enumerate(batch.column(2).to_pylist()):
        text = text or b""
        for at in range(0, max(len(text) - length + 1, 0), PART):
            piece = text[at : at + PART + length - 1]
            rows.append((row, at))
            pieces.append(piece)
            size += len(piece)
            ends.append(size)
            if size >= PART:
                yield rows, b"".join(pieces), ends
                rows, pieces, ends, size = [], [], [], 0
    if pieces:
        yield rows, b"".join(pieces), ends


def _emit_cells(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, bytes) to cells."""
    worker_cache("suffix")
    kind_of = xxhash.xxh3_128_digest
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for rows, data, ends in _parts(batch, length):
            ends = np.array(ends)
            first, count, anchor, lead = cells(np.frombuffer(data, np.uint8), ends, length, gram)
            if not len(first):
                continue
            piece = np.searchsorted(ends, first, side="right")
            row, at = np.array(rows).T
            begin = np.concatenate(([0], ends[:-1]))
            kinds = [kind_of(data[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor),
                    pa.array(kinds, pa.binary()),
                    pa.array(ids[row[piece]]),
                    pa.array(marks[row[piece]]),
                    pa.array(first - begin[piece] + at[piece]),
                    pa.array(count.astype(np.int32)),
                    pa.array(lead.astype(np.int32)),
                ],
                names=["anchor", "kind", "id", "mark", "start", "windows", "lead"],
            )


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first `depth` bytes at least, in two stages.

    A suffix smaller than its successor is sorted directly. The others follow by scanning the buckets
    of first bytes upwards: the suffix before a sorted one goes to the front of its own bucket.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    # smaller than the successor: by the next byte that differs; the end of the text is least
    change = np.flatnonzero(data[1:] != data[:-1])
    run_end = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, bool)
    has = run_end < len(change)
    at = change[run_end[has]]
    smaller[has] = data[at] < data[at + 1]
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    direct_by_byte = np.searchsorted(data[direct], np.arange(257)) if n else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(data[-1])].append(np.array([n - 1]))  # before the empty suffix, the least of all
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Hand on the suffixes before those found; what belongs to the bucket being scanned comes back."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = data[before]
        same = before[first == byte]
        before, first = before[first != byte], first[first != byte]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[int(data[part[0]])].append(part)
        return same

    for byte in np.unique(data).tolist():
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        own = direct[direct_by_byte[byte] : direct_by_byte[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out)


def repeated_windows(text: bytes, valid: np.ndarray, length: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Which of the places marked valid start `length` bytes that another valid place starts too.

    With owner, a number for each place, only a place of another owner counts.
    """
    order = suffix_array(text, length)
    order = order[valid[order]]
    again = np.zeros(len(text), bool)
    if len(order) < 2:
        return again
    padded = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    pairs = np.arange(len(order) - 1)  # neighbours whose common prefix may still reach `length`
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        pairs = pairs[words[order[pairs] + at] == words[order[pairs + 1] + at]]
        if not len(pairs):
            return again
    if owner is None:
        again[order[pairs]] = True
        again[order[pairs + 1]] = True
        return again
    new = np.ones(len(order), bool)
    new[pairs + 1] = False
    begin = np.flatnonzero(new)
    of = owner[order]
    mixed = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
    again[order[np.repeat(mixed, np.diff(np.append(begin, len(order))))]] = True
    return again


SPANS = "id bigint, mark bigint, first bigint, last bigint"


def _search_groups(batches: Iterator[pa.RecordBatch], length: int, across: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (group, id, mark, start, windows, lead, n, bytes) to spans of repeated windows."""

    def search(rows: list[tuple]) -> pa.RecordBatch | None:
        text = b"".join(r[7] for r in rows)
        valid = np.zeros(len(text), bool)
        owner = np.zeros(len(text), np.int64) if across else None
        owners: dict[tuple, int] = {}
        begins, at = [], 0
        for r in rows:
            begins.append(at)
            valid[at : at + r[4]] = True
            if across:
                owner[at : at + r[4]] = owners.setdefault((r[1], r[2]), len(owners)) if r[6] == 1 else -1 - len(begins)
            at += len(r[7])
        again = repeated_windows(text, valid, length, owner)
        out = []
        for begin, r in zip(begins, rows, strict=True):
            if r[6] > 1:  # stands for others: all of it is known to repeat
                continue
            flags = again[begin : begin + r[4]]
            if flags.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                out += [(r[1], r[2], r[3] + int(a), r[3] + int(b) - 1 + length) for a, b in edges.reshape(-1, 2)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "mark", "first", "last"])

    held: list[tuple] = []
    size, group, begun = 0, None, 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if row[0] != group:
                if size >= SPAN:
                    found = search(held)
                    held, size = [], 0
                    if found is not None:
                        yield found
                elif held and len(held) - begun == 1:  # a group of one: nothing to compare
                    size -= len(held.pop()[7])
                group, begun = row[0], len(held)
            held.append(row)
            size += len(row[7])
    if held and (found := search(held)) is not None:
        yield found


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (bytes, id, mark, cells) to one row per cell with its bytes."""
    for batch in batches:
        texts, ids, marks, lists = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for text, id_, mark, found in zip(texts, ids, marks, lists, strict=True):
            for c in found:
                out.append((c["anchor"], id_, mark, c["start"], c["windows"], c["lead"], c["n"], text[c["start"] : c["start"] + c["windows"] + length - 1]))
            if len(out) > 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


PIECES = pa.schema(
    [("group", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("lead", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary())]
)
PIECES_SQL = "group bigint, id bigint, mark bigint, start bigint, windows int, lead int, n bigint, bytes binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)


def _blocks(pieces: DataFrame, length: int, gram: int, size: int) -> DataFrame:
    """Cut pieces into blocks of `size` windows, dealt by place relative to the anchor.

    A block's group is the hash of the bytes that all its windows share, those of other pieces too.
    """
    place = F.lit(length - gram) - F.col("lead")  # of the first window, from 0
    both = pieces.withColumn("place", place).withColumn("block", F.explode(F.expr(f"sequence(place div {size}, (place + windows - 1) div {size})")))
    both = both.withColumn("from", F.expr(f"cast(greatest(block * {size} - place, 0) as int)")).withColumn(
        "upto", F.expr(f"cast(least((block + 1) * {size} - place, windows) as int)")
    )
    shared = F.expr(f"substring(bytes, cast((block + 1) * {size} - place as int), {length + 1 - size})")
    return both.select(
        F.xxhash64("group", "block", shared).alias("group"),
        "id",
        "mark",
        (F.col("start") + F.col("from")).alias("start"),
        (F.col("upto") - F.col("from")).alias("windows"),
        (F.col("lead") - F.col("from")).alias("lead"),
        "n",
        F.expr(f"substring(bytes, from + 1, upto - from + {length - 1})").alias("bytes"),
    )


def key_of(docs: DataFrame, id: str) -> Column:
    """A number that tells ids apart: whole numbers are their own, others their hash; null gets the least number."""
    key = F.col(id).cast("bigint") if isinstance(docs.schema[id].dataType, IntegralType) else F.when(F.col(id).isNotNull(), F.xxhash64(F.col(id)))
    return F.coalesce(key, F.lit(-(2**63)).cast("bigint"))


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, mark, bytes): the key of each row and the bytes of its text; mark tells texts of one id apart."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    return docs.select(key_of(docs, id).alias("id"), data.alias("bytes")).select("id", F.xxhash64("bytes").alias("mark"), "bytes")


def repeated_spans(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, across: bool = False
) -> DataFrame:
    """(id, mark, first, last): bytes [first, last) of texts that hold only repeated strings of `length` bytes.

    A string repeats if it starts at any other place, in the same text or another; places are judged
    on the input. Spans of a text may overlap and repeat. Equal rows count as copies of each other.
    (id, mark) is the key that keyed() gives. Null texts are empty; texts below `length` give nothing.
    With across, only repeats in rows of another key count; text may be binary.
    """
    return spans_of(keyed(docs, id, text), length, gram, group, across)


def _packed_words(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, bytes of a text) to the same with a hash for each word; texts of fewer words go."""
    digest = xxhash.xxh32_digest
    for batch in batches:
        found = [_WORD.findall(t.decode()) for t in batch.column(2).to_pylist()]
        kept = pa.array([i for i, w in enumerate(found) if len(w) >= words], pa.int64())
        packed = [b"".join(map(digest, found[i])) for i in kept.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(packed, pa.binary())], names=["id", "mark", "bytes"])


def repeated_word_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = RUN_WORDS, group: int = GROUP) -> DataFrame:
    """(id, mark, first, last): bytes of the packed word hashes that rows of another key hold too, `words` words at least.

    Words are what white space parts (see _WORD), so other line breaks make no other passage. A span may begin or end within a
    hash, and of places in one row that are alike one may stand for all; cut_words() sees to both. Exact but for
    32-bit collisions of a passage's words.
    """
    packed = keyed(docs, id, text).mapInArrow(lambda b: _packed_words(b, words), "id bigint, mark bigint, bytes binary")
    length = words * WORD_BYTES
    return spans_of(packed, length, length // 3, group, across=True)


def cut_words(value: str, spans: list[tuple[int, int]], words: int) -> np.ndarray:
    """Places (first, last) of the bytes of a text that spans of its packed hashes and their like in it cover."""
    places = np.array([m.span() for m in _WORD.finditer(value)]).reshape(-1, 2)
    packed = np.frombuffer(b"".join(map(xxhash.xxh32_digest, _WORD.findall(value))), np.uint8)
    passages = gram_hashes(packed, words * WORD_BYTES)[::WORD_BYTES]
    known = np.zeros(len(passages), bool)
    for first, last in spans:
        known[-(-first // WORD_BYTES) : max(0, last // WORD_BYTES - words + 1)] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.isin(passages, passages[known]).view(np.int8), [0])))).reshape(-1, 2)
    byte = np.append(np.flatnonzero((np.frombuffer(value.encode(), np.uint8) & 0xC0) != 0x80), len(value.encode()))
    return np.stack([byte[places[edges[:, 0], 0]], byte[places[edges[:, 1] + words - 2, 1]]], axis=1)


def spans_of(source: DataFrame, length: int, gram: int, group: int = GROUP, across: bool = False) -> DataFrame:
    """repeated_spans() of rows (id, mark, bytes)."""
    if length <= gram or length < 8:
        raise ValueError("length must be over gram and at least 8")
    spark = source.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    stored = scratch.stored
    found = stored(source.mapInArrow(lambda b: _emit_cells(b, length, gram), CELLS), "cells")
    tag = F.xxhash64("kind")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min(tag).alias("a"), F.max(tag).alias("b")).where("n > 1")
    # a table of its own, so that the join reads two plain exchanges, of which Spark can split a common anchor's
    anchors = stored(anchors.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    shared = scratch.replaced(found, found.join(anchors, "anchor"), "shared")
    place = F.struct("id", "mark")
    copies_of = F.when(F.min(place) != F.max(place), 2).otherwise(1).cast("bigint") if across else F.count("*")
    kinds = shared.groupBy("anchor", "kind").agg(
        copies_of.alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("id", "mark", "start", "windows", "lead")).alias("one")
    )
    kinds = stored(kinds, "kinds")
    copies = shared.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi")
    spans = copies.select("id", "mark", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1 + length).alias("last"))
    spans = scratch.replaced(shared, spans, "copies")
    wanted = (
        kinds.where("mixed")
        .select("one.id", "one.mark", F.struct("anchor", "one.start", "one.windows", "one.lead", "n").alias("cell"))
        .groupBy("id", "mark")
        .agg(F.collect_list("cell").alias("cells"))
    )
    texts = source.join(wanted, ["id", "mark"]).select("bytes", "id", "mark", "cells")
    pieces = stored(texts.mapInArrow(lambda b: _slices(b, length), PIECES_SQL), "pieces")
    size = length - gram + 1
    while True:
        # equal rows of documents give equal pieces; a kind of bytes in a group needs one
        sizes = pieces.groupBy("group").count()
        large = stored(sizes.where(F.col("count") > group), "large")
        again = large.limit(1).count() > 0
        small = pieces.join(large, "group", "left_anti") if again else pieces
        bounded_batches(spark)
        dealt = small.repartition(partitions(spark), "group").sortWithinPartitions("group")
        spans = spans.unionByName(stored(dealt.mapInArrow(lambda b: _search_groups(b, length, across), SPANS), "spans"))
        if not again:
            return scratch.result(spans, "spans")
        size = max(1, size // 4)
        marked = _blocks(pieces.join(large, "group", "left_semi"), length, gram, size)
        marked = stored(marked.withColumn("kind", F.sha2("bytes", 256)), "blocks")
        copies_of = F.when((F.min(place) != F.max(place)) | (F.max("n") > 1), 2).otherwise(1).cast("bigint") if across else F.sum("n")
        kinds = marked.groupBy("group", "kind").agg(copies_of.alias("n"), F.min(F.struct("id", "mark", "start", "windows")).alias("one"))
        kinds = stored(kinds, "kinds")
        repeats = marked.where("n = 1").join(kinds.where("n > 1").select("group", "kind"), ["group", "kind"], "left_semi")
        spans = spans.unionByName(
            repeats.select("id", "mark", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1 + length).alias("last"))
        )
        several = stored(kinds.groupBy("group").count().where("count > 1").select("group"), "several")
        ones = kinds.join(several, "group", "left_semi").select("group", "one.*", F.col("n").alias("total"))
        pieces = marked.drop("kind").join(ones, ["group", "id", "mark", "start", "windows"]).select(
            "group", "id", "mark", "start", "windows", "lead", F.col("total").alias("n"), "bytes"
        )
        pieces = stored(pieces, "pieces")


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, spans_at: int) -> Iterator[pa.RecordBatch]:
    """Append kept BINARY, n_bytes, n_removed, n_spans and the merged spans."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        kept, sizes, removed, merged = [], [], [], []
        for data, spans in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((s["first"], s["last"]) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            at, parts = 0, []
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            kept.append(b"".join(parts))
            sizes.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            merged.append([{"first": a, "last": b} for a, b in runs])
        arrays = [batch.column(i) for i in range(batch.num_columns) if i not in (text_at, spans_at)]
        names = [n for i, n in enumerate(batch.schema.names) if i not in (text_at, spans_at)]
        arrays += [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(m) for m in merged], pa.int64()), pa.array(merged, span)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "kept", "n_bytes", "n_removed", "n_spans", "spans"])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, kept BINARY, n_bytes, n_removed, n_spans, spans): each row of docs without its repeated strings.

    spans are the maximal runs of removed bytes. Null texts are empty; ids may repeat or be null; rows
    stay as many as they are. Strings are judged on the input, so all places of a repeat go.
    """
    spans = repeated_spans(docs, id, text, length, gram, group)
    by_text = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id).alias("_id"), key_of(docs, id).alias("id"), data.alias("bytes")).select(
        "_id", "id", F.xxhash64("bytes").alias("mark"), "bytes"
    )
    joined = rows.join(by_text, ["id", "mark"], "left").select("_id", "bytes", "found")
    kind = docs.schema[id].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    out = joined.mapInArrow(
        lambda b: _cut(b, 1, 2),
        f"_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<first:bigint,last:bigint>>",
    )
    return out.withColumnRenamed("_id", id)


def without_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", length: int | None = LENGTH, words: int | None = None
) -> DataFrame:
    """docs with their columns, texts without repeated strings; rows all of whose text repeats go.

    With length, strings of so many bytes that occur at any other place go; with words, passages of so many
    words that other rows hold too go, however few their bytes and whatever white space parts them. Both are
    judged on the input, so all places of a repeat go. One of the two must be given.
    Bytes of a character that a span cuts go with it. n_chars, if docs has it, is counted again. Null
    texts stay null, empty ones empty.
    """
    searches = [repeated_spans(docs, id, text, length).withColumn("words", F.lit(False))] if length else []
    searches += [repeated_word_spans(docs, id, text, words).withColumn("words", F.lit(True))] if words else []
    spans = reduce(DataFrame.unionByName, searches)
    own, mark, found, cut_name = (free_name(n, docs) for n in ("_own", "_mark", "_found", "_cut"))
    spans = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "last", "words")).alias(found))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = docs.withColumns({own: key_of(docs, id), mark: F.xxhash64(data)})
    joined = named.join(spans, (named[own] == spans["id"]) & (named[mark] == spans["mark"]), "left").select(*[named[c] for c in docs.columns], found)
    bounded_batches(docs.sparkSession)

    names = list(docs.columns)
    # one pass in one worker: a function of a column would run again for each use of its result
    at, spans_at = joined.columns.index(text), joined.columns.index(found)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffix")
        for batch in batches:
            out, changed = [], []
            for value, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                changed.append(False)
                if spans:
                    raw = np.frombuffer(value.encode(), np.uint8)
                    keep = np.ones(len(raw), bool)
                    for s in spans:
                        if not s["words"]:
                            keep[s["first"] : s["last"]] = False
                    runs = [(s["first"], s["last"]) for s in spans if s["words"]]
                    for a, z in cut_words(value, runs, words).tolist() if runs else ():
                        keep[a:z] = False
                    changed[-1] = not keep.all()
                    value = raw[keep].tobytes().decode("utf-8", "ignore")
                out.append(value)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed, pa.bool_())], names=[*names, cut_name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = joined.mapInArrow(rest, f"{kinds}, {cut_name} boolean").where(~F.col(cut_name) | (F.length(text) > 0))
    if n_chars and n_chars in docs.columns:
        count = F.when(F.col(cut_name), F.length(text)).otherwise(F.col(n_chars))
        cut = cut.withColumn(n_chars, count.cast(docs.schema[n_chars].dataType))
    return cut.select(*docs.columns)
