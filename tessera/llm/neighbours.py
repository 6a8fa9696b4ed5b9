"""Approximate nearest neighbours by cosine: a forest of random-projection trees, searched best first.

Each tree halves a bounded sample at the median of its projection on a random direction, level by
level, until a leaf stands for about LEAF rows of the table. Every vector is filed under its leaf in each
tree. A query walks all trees with one shared priority queue: the leaf next visited is that for which the
query has crossed planes by the least sum of squared margins. Candidates of visited leaves are ranked
exactly, in double precision. Leaves travel and are ranked a branch of the tree at a time, so a query and
what it finds are sent once for each branch, not for each leaf.

How many leaves a query visits isn't a constant: for a bounded sample of the table's own vectors the true
neighbours are found by one exact pass over all rows, and the number is that which would have found the
wanted share of them. Tables with clusters need few leaves; of vectors without any structure no index can
pass over many, and the number says so.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import bounded_batches, hash_bound, stored

#: Vectors that the trees are fitted to, and components of them all: bounds of what the driver holds. SAMPLED of
#: them make a leaf at least.
SAMPLE, COMPONENTS, SAMPLED = 65_536, 1 << 22, 8
TREES = 4
#: Rows of the table that a leaf stands for, while the sample allows so many leaves.
LEAF = 64
#: Share of true neighbours that the visited leaves must hold, and vectors whose neighbours are looked at for that.
RECALL, PROBES = 0.98, 256
#: Vectors that are ranked together: leaves below one node that stand for so many are a branch, to which a query
#: goes once with the list of its leaves. Larger branches, and those that more queries visit, are dealt out in parts.
PART = 4096
#: Cosines that are worked out at once.
BLOCK = 1 << 20


@dataclass
class Forest:
    """Complete binary trees in heap order: directions (trees, nodes, dims) and thresholds (trees, nodes)."""

    depth: int
    planes: np.ndarray
    cuts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, vectors) leaf numbers."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[t][node]) >= self.cuts[t][node])
            out[t] = node - (2**self.depth - 1)
        return out

    def visit(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of all leaves, the best first for one vector."""
        first = 2**self.depth - 1
        side = self.planes @ x - self.cuts
        heap = [(0.0, t, 0) for t in range(len(self.planes))]
        while heap:
            owed, tree, node = heapq.heappop(heap)
            while node < first:
                margin = side[tree, node]
                near = 2 * node + 1 + (margin >= 0)
                heapq.heappush(heap, (owed + margin * margin, tree, 4 * node + 3 - near))
                node = near
            yield tree, int(node) - first


def fit(sample: np.ndarray, trees: int = TREES, leaves: int = 128, seed: int = 5) -> Forest:
    """Trees over unit vectors with `leaves` leaves, a power of two, each; fewer where the sample is small."""
    rng = np.random.default_rng(seed)
    depth = max(0, min(leaves, len(sample) // SAMPLED).bit_length() - 1)
    dims, nodes = sample.shape[1], 2**depth - 1
    planes = rng.normal(size=(trees, nodes, dims))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True) if nodes else 1
    cuts = np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = held.pop(node)
            along = sample[rows] @ planes[t, node]
            cuts[t, node] = np.median(along) if len(rows) else 0.0
            held[2 * node + 1], held[2 * node + 2] = rows[along < cuts[t, node]], rows[along >= cuts[t, node]]
    return Forest(depth, planes, cuts)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component to between a half and one: exact, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors that take part, repeated rows once. v keeps its type: floats travel as floats.

    Left out: null ids, null vectors, those with null or non-finite components and those of zeros alone, empty ones
    too. Shorter vectors than the longest get zeros at their end.
    """
    v, kind = F.col("v"), vectors.schema[embedding].dataType.elementType
    whole = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    whole = whole.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall(v, finite), F.lit(False)) & F.exists(v, lambda x: x != 0))
    shortest, longest = whole.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if longest and shortest < longest:
        whole = whole.withColumn("v", F.concat(v, F.array_repeat(F.lit(0).cast(kind), F.lit(longest) - F.size(v))))
    return whole.distinct()


def _best(asked: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of at least the k best rows of each query, ties included; double precision."""
    asked, rows = _scaled(asked), _scaled(rows)
    qn, xn = np.sqrt((asked * asked).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    rough = (asked / qn[:, None]) @ (rows / xn[:, None]).T
    at = max(0, len(rows) - k)
    floor = np.partition(rough, at, axis=1)[:, at] - 1e-9
    qs, xs = np.nonzero(rough >= floor[:, None])
    return qs, xs, (asked[qs] * rows[xs]).sum(axis=1) / (qn[qs] * xn[xs])


def nearest_entries(entries: DataFrame, asked: np.ndarray, k: int) -> DataFrame:
    """(q, score, v): the k nearest entries of each of a bounded block of vectors, exactly, by one pass over all rows.

    q numbers the vectors of the block. A task keeps k rows for each; they meet in an aggregation.
    """
    dims, shared = asked.shape[1], entries.sparkSession.sparkContext.broadcast(asked)
    kind = entries.schema["v"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0), dims)
            for q, x, score in zip(*_best(shared.value, rows, k), strict=True):
                held[int(q)].append((float(score), rows[x].copy()))
            for q, found in held.items():
                if len(found) > k:
                    held[q] = heapq.nlargest(k, found, key=lambda f: f[0])
        flat = [(q, s, v.tolist()) for q, found in held.items() for s, v in found]
        if flat:
            q, s, v = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float64()), pa.array(v, pa.list_(pa.float32() if "float" in kind else pa.float64()))], names=["q", "score", "v"])

    near = entries.select("v").mapInArrow(scan, f"q int, score double, v {kind}")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.xxhash64("v"))
    return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def leaves_needed(forest: Forest, entries: DataFrame, probes: np.ndarray, k: int, recall: float) -> int:
    """Leaves that a query must visit so that they hold a share `recall` of the k true neighbours of the probes."""
    found = nearest_entries(entries, probes, k + 1).collect()  # PROBES * (k + 1) rows at most
    unit = _unit(probes)
    near: dict[int, list] = defaultdict(list)
    for r in found:
        near[r["q"]].append(r["v"])
    ranks = []
    for q, vectors in near.items():
        vectors = np.array(vectors, np.float64)
        vectors = vectors[(vectors != probes[q]).any(axis=1)][:k]  # not the probe itself
        if not len(vectors):
            continue
        where = defaultdict(list)
        for t, row in enumerate(forest.leaves(_unit(vectors))):
            for i, leaf in enumerate(row):
                where[t, int(leaf)].append(i)
        left = set(range(len(vectors)))
        for n, spot in enumerate(forest.visit(unit[q]), 1):
            gone = left.intersection(where.get(spot, ()))
            ranks += [n] * len(gone)
            left -= gone
            if not left:
                break
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def _sizes(filed: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Entries and ids of each (tree, leaf): as many rows as the trees have leaves, which the sample bounds."""
    per = filed.groupBy("tree", "leaf").agg(F.count("*").alias("entries"), F.sum(F.size("ids")).alias("ids")).collect()
    return {(r["tree"], r["leaf"]): (r["entries"], r["ids"]) for r in per}


def _parts(rows: DataFrame, most: int) -> dict[tuple[int, int], int]:
    """Parts of at most about `most` rows that a (tree, branch) must be dealt into; those of one part aren't listed."""
    large = rows.groupBy("tree", "branch").count().where(F.col("count") > most).collect()  # one row per branch at most
    return {(r["tree"], r["branch"]): math.ceil(r["count"] / most) for r in large}


def _ranked(asked: pa.Table, filed: pa.Table, dims: int, k: int, schema: pa.Schema) -> pa.Table:
    """The k best of a branch's vectors for each query, among the leaves that it visits.

    Queries go through a product of matrices a block at a time; vectors of leaves that one doesn't visit are ruled out of its row.
    """
    if not asked.num_rows or not filed.num_rows:
        return schema.empty_table()
    rows = _scaled(_matrix(filed["v"], dims))
    xn = np.sqrt((rows * rows).sum(axis=1))
    unit = (rows / xn[:, None]).T
    kinds, place = np.unique(filed["leaf"].to_numpy(), return_inverse=True)
    known = {n: i for i, n in enumerate(kinds.tolist())}
    all_q, all_leaves = _scaled(_matrix(asked["v"], dims)), asked["leaves"].to_pylist()
    qs, xs, scores = [], [], []
    block = max(1, BLOCK // len(rows))
    for begin in range(0, len(all_q), block):
        q = all_q[begin : begin + block]
        visited = np.zeros((len(q), len(kinds)), bool)
        for i, leaves in enumerate(all_leaves[begin : begin + block]):
            visited[i, [known[n] for n in leaves if n in known]] = True
        qn = np.sqrt((q * q).sum(axis=1))
        rough = (q / qn[:, None]) @ unit
        rough[~visited[:, place]] = -np.inf
        at = max(0, len(rows) - k)
        floor = np.maximum(np.partition(rough, at, axis=1)[:, at] - 1e-9, -2)  # cosines are above that, what was ruled out is below
        qi, xi = np.nonzero(rough >= floor[:, None])
        qs.append(qi + begin)
        xs.append(xi)
        scores.append((q[qi] * rows[xi]).sum(axis=1) / (qn[qi] * xn[xi]))
    at = pa.array(np.concatenate(qs))
    return pa.table([asked["q"].take(at), filed["ids"].take(pa.array(np.concatenate(xs))), pa.array(np.concatenate(scores))], schema=schema)


def search(
    vectors: DataFrame, is_query, id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, exact: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first, ties to the smaller id.

    is_query: a condition on column vec_id. Candidates are all other rows that usable() keeps; score is
    the cosine of the original vectors in double precision. Equal vectors are one entry with its k + 1
    least ids, which is all that a result can show of them. A query goes on beyond its number of leaves until
    those that it has visited hold k other rows, so one with fewer candidates than k gets them all. With
    exact, every leaf is visited. An empty table, or one where nothing is usable, gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2000)
    rows = stored(usable(vectors, id, embedding), "vectors")
    first = rows.select("v").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not first:
        return spark.createDataFrame([], schema)
    dims, kind = len(first[0]["v"]), rows.schema["v"].dataType.simpleString()
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    entries = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.select(F.concat_ws(":", F.col("ids")[0], F.xxhash64("v")).alias("key"), "ids", "v"), "entries")
    # an entry is known by its least id, and so is the vector of a query
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = queries.join(entries.select("v", F.col("ids")[0].alias("q")), "v")
    asked = stored(queries.groupBy("q").agg(F.first("v").alias("v")), "asked")

    total = entries.count()
    order = F.xxhash64("key")
    size = max(SAMPLED, min(SAMPLE, COMPONENTS // dims))
    taken = entries.where(order <= hash_bound(1.2 * size / total)).orderBy(order).limit(size).select("v").toArrow()
    sample = _matrix(taken["v"], dims)
    forest = fit(_unit(sample), trees, max(1, total // leaf))
    every = trees * 2**forest.depth
    most = every if exact or forest.depth == 0 else min(every, leaves_needed(forest, entries, sample[:PROBES], k, recall))
    # levels of the trees that lie within a branch
    inner = min(forest.depth, max(0, int(math.log2(PART * 2**forest.depth / total)) if total < PART * 2**forest.depth else 0))
    shared = spark.sparkContext.broadcast(pickle.dumps(forest))
    spot = "tree int, branch int"

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(shared.value)
        for batch in batches:
            if batch.num_rows:
                for t, found in enumerate(forest.leaves(_unit(_matrix(batch.column(1), dims)))):
                    found = found.astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(found >> inner), pa.array(found), *batch.columns], names=["tree", "branch", "leaf", "ids", "v"]
                    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(shared.value)
        for batch in batches:
            for i, x in enumerate(_unit(_matrix(batch.column(1), dims)) if batch.num_rows else ()):
                branches: dict[tuple[int, int], list[int]] = defaultdict(list)
                held = [0] * trees  # rows of a tree are told apart, those of several trees may be the same
                for visited, (t, n) in enumerate(forest.visit(x)):
                    if visited >= most and max(held) > k:
                        break
                    branches[t, n >> inner].append(n)
                    held[t] += known.value.get((t, n), (0, 0))[1]
                tree, branch = np.array(list(branches), np.int32).T
                one = batch.take(pa.array(np.full(len(branches), i)))
                leaves = pa.array(list(branches.values()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(branch), leaves, *one.columns], names=["tree", "branch", "leaves", "q", "v"])

    filed = entries.select("ids", "v").mapInArrow(file, f"{spot}, leaf int, ids array<bigint>, v {kind}")
    sizes = _sizes(filed.select("tree", "leaf", "ids"))
    known = spark.sparkContext.broadcast(sizes)
    sent = stored(asked.select("q", "v").mapInArrow(ask, f"{spot}, leaves array<int>, q bigint, v {kind}"), "sent")
    # a branch with many vectors or many queries is dealt out as pairs of parts; others have one
    branches: dict[tuple[int, int], int] = defaultdict(int)
    for (t, n), (count, _) in sizes.items():
        branches[t, n >> inner] += count
    sides = {b: math.ceil(n / PART) for b, n in branches.items() if n > PART}, _parts(sent, PART)
    held = spark.sparkContext.broadcast(sides)

    def dealt(at: int, key: str):
        @F.pandas_udf("array<struct<a:int,b:int>>")
        def of(tree: pd.Series, branch: pd.Series, value: pd.Series) -> pd.Series:
            out = []
            for t, n, x in zip(tree, branch, value, strict=True):
                own, other = held.value[at].get((t, n), 1), held.value[1 - at].get((t, n), 1)
                mine = int(xxhash.xxh3_64_intdigest(str(x)) % own) if own > 1 else 0
                out.append([{"a": mine, "b": i} if at == 0 else {"a": i, "b": mine} for i in range(other)])
            return pd.Series(out)

        return F.explode(of("tree", "branch", key)).alias("part")

    if sides[0] or sides[1]:
        filed = filed.withColumn("key", F.col("ids")[0]).select("*", dealt(0, "key")).select("*", "part.*").drop("part", "key")
        sent = sent.select("*", dealt(1, "q")).select("*", "part.*").drop("part")
    else:
        filed, sent = (x.withColumns({"a": F.lit(0), "b": F.lit(0)}) for x in (filed, sent))
    spots = ["tree", "branch", "a", "b"]
    found = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    near = sent.groupBy(*spots).cogroup(filed.groupBy(*spots)).applyInArrow(
        lambda asked, filed: _ranked(asked, filed, dims, k + 1, found), "q bigint, ids array<bigint>, score double"
    )
    near = near.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    lists = stored(lists, "nearest")
    out = queries.select("query_id", "q").join(lists, "q").select("query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    out = out.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
