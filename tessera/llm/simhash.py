"""SimHash near-duplicates: fingerprints, links within a Hamming budget, classes of linked documents.

Candidates come from the pigeonring: cut 64 bits into budget + 1 segments in a ring. If two
fingerprints differ in at most `budget` bits, some segment starts a chain whose first l segments
together differ in at most l * budget / (budget + 1) bits, for every l: none in the first, at most one
in the first two, at most two in the first three. The keys of a fingerprint are its bits under masks
that fix the first segment of a chain and enough pieces of the next ones for such a budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, free_name, partitions, stored, worker_cache
from tessera.llm.graph import connected_components

BITS = 64
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: From so many distinct fingerprints on, the longer chain's keys are used: more of them, each more selective.
LONG_CHAIN_FROM = 4_000_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, see fingerprints()."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces only
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """(id, out BIGINT): the SimHash of each whole text.

    A-Z are lower-cased; words are runs of anything but the six ASCII white spaces; a shingle is
    `words` of them joined by a space, repeats count; a text with fewer words is one shingle; without
    words (null, empty) the fingerprint is zero. Bits are set where more than half the shingles'
    XXH64 (seed 42) have them. Other columns are dropped, repeated rows stay.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        worker_cache("simhash")
        return pd.Series(np.array([fingerprint(x, words) for x in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id), of(F.col(text)).alias(out))


def segments(budget: int) -> list[int]:
    """Masks of the ring's budget + 1 segments, as even as can be."""
    cuts = np.linspace(0, BITS, budget + 2).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pieces(mask: int, n: int) -> list[int]:
    bits = [i for i in range(BITS) if mask >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(bits, n)]


def key_masks(budget: int, long_chain: bool = False) -> list[int]:
    """Masks under one of which any two fingerprints within the budget agree (needs budget >= 2).

    The first segment of the viable chain agrees. The next one holds at most one difference, so of its
    two pieces one agrees. Or, with the longer chain: the next two hold at most two differences, so of
    their four pieces two agree.
    """
    ring, out = segments(budget), []
    for i, first in enumerate(ring):
        if long_chain:
            rest = _pieces(ring[(i + 1) % len(ring)], 2) + _pieces(ring[(i + 2) % len(ring)], 2)
            out += [first | a | b for a, b in combinations(rest, 2)]
        else:
            out += [first | a for a in _pieces(ring[(i + 1) % len(ring)], 2)]
    return out


def within_budget(x: np.ndarray, y: np.uint64, budget: int) -> np.ndarray:
    """Which of x lie within `budget` bits of y: the ring's chains first, the full count for the rest."""
    difference = x ^ y
    ring = np.array(segments(budget), np.uint64)
    each = np.bitwise_count(difference[:, None] & ring[None, :]).astype(np.int16)
    alive = each == 0
    total = each
    for length in range(2, len(ring)):
        total = total + np.roll(each, 1 - length, axis=1)
        alive &= total <= length * budget // len(ring)
    out = alive.any(axis=1)
    out[out] = np.bitwise_count(difference[out]) <= budget
    return out


def forest(values: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that join all values of a bucket that links within it join; one fewer than values at most.

    Grows a component at a time: each member is compared with what isn't joined yet, so a dense group
    costs little more than its size.
    """
    left, links = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = within_budget(left, x, budget)
            if near.any():
                found = left[near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return links


LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_buckets(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key, lo, hi); lo and hi are the pair of blocks that a bucket's part compares."""
    rest: list[np.ndarray] | None = None

    def linked(bucket: np.ndarray) -> list[tuple[int, int]]:
        return forest(np.unique(bucket), budget) if len(bucket) > 1 else []

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        fp = columns[4].view(np.uint64)
        new = np.zeros(len(fp), bool)
        for c in columns[:4]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            rest = columns
            continue
        cuts = np.concatenate(([0], cuts))
        many = np.flatnonzero(np.diff(cuts) > 1)
        out = [link for i in many for link in linked(fp[cuts[i] : cuts[i + 1]])]
        rest = [c[cuts[-1] :] for c in columns]
        if out:
            a, b = np.array(out, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINK_SCHEMA)
    if rest is not None and (out := linked(rest[4].view(np.uint64))):
        a, b = np.array(out, np.uint64).view(np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINK_SCHEMA)


def links(distinct: DataFrame, fp: str = "fp", budget: int = 4, long_chain: bool | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links of at most `budget` differing bits that join what all such links join.

    distinct: each fingerprint once. A bucket gives at most one link less than it has members. Buckets
    above `block` rows are dealt out as pairs of blocks over several tasks, each pair compared whole.
    """
    spark = distinct.sparkSession
    bounded_batches(spark, 20_000)  # rows of a few numbers
    if long_chain is None:
        long_chain = distinct.count() >= LONG_CHAIN_FROM
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(budget, long_chain)]
    keyed = distinct.select(
        F.col(fp).alias("fp"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("mask", "key"),
    )
    large = keyed.groupBy("mask", "key").count().where(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    dealt = keyed.join(large, ["mask", "key"], "left").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("mask", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    dealt = dealt.repartition(partitions(spark), "mask", "key", "lo", "hi").sortWithinPartitions("mask", "key", "lo", "hi")
    return dealt.mapInArrow(lambda batches: _link_buckets(batches, budget), "a bigint, b bigint")


def components(docs: DataFrame, id: str = "doc_id", text: str = "text", budget: int = 4, words: int = 4) -> DataFrame:
    """(id, fp, component_id): one row per document; component_id is the least id of its class.

    Documents link if their fingerprints differ in at most `budget` bits; a class is all that links
    reach, itself included. Equal texts have equal fingerprints and are one node, however many there
    are. Documents without words share the fingerprint zero and link like any other. Null ids stay and
    never become a component_id, unless the whole class has none. Repeated rows stay.
    """
    spark = docs.sparkSession
    marked = stored(fingerprints(docs, id, text, words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min(id).alias("least"))
    joined = connected_components(links(nodes.select("fp"), budget=budget), "a", "b")
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root")
    )
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_fp = stored(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(of_fp, "fp").select(id, "fp", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", budget: int = 4, words: int = 4) -> DataFrame:
    """The documents that stay: of each class one row, that with the least id; columns stay.

    Rows without an id come after all others; of rows that repeat the least id, or of a class without
    any, the text with the least hash stays, and of rows that repeat that too, one. So each class keeps
    exactly one row, whether ids are unique or not. An empty table stays empty.
    """
    own, mark = (free_name(n, docs) for n in ("_own", "_mark"))
    named = docs.withColumns({own: F.col(id), mark: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    texts = named.select(F.struct(F.col(own).isNull().alias("unnamed"), F.col(own).alias("own"), F.col(mark).alias("mark")).alias("row"), F.col(text).alias("text"))
    marked = stored(fingerprints(texts, "row", "text", words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("row").alias("least"))
    joined = connected_components(links(nodes.select("fp"), budget=budget), "a", "b")
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("least", F.coalesce("root", nodes["fp"]).alias("root"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("row")).select("row")
    times = marked.groupBy("row").agg(F.count("*").alias("times"))
    stay = stored(stay.join(times, "row").select("row.own", "row.mark", "times"), "kept")
    same = lambda rows: named[own].eqNullSafe(rows["own"]) & (named[mark] == rows["mark"])
    # rows that agree in id and text are few, so only they are brought together
    once, several = stay.where("times = 1"), stay.where("times > 1")
    single = named.join(once, same(once), "left_semi")
    again = named.join(several, same(several), "left_semi").dropDuplicates([own, mark])
    return single.unionByName(again).select(*docs.columns)
