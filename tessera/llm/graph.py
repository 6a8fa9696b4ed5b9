"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    # the least neighbours are a table, so that the join reads two plain exchanges, of which Spark can split a hub's
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Return (node, root) for every node of a link that isn't its component's least node.

    edges: two orderable columns of one type, in either direction; rows with a null or with equal
    ends are ignored, repeats don't matter. Nodes without a link don't appear. Links are stars after
    O(log n) rounds; each round is written to the shared folder. Raises if max_rounds don't settle it.
    """
    scratch = Scratch(edges.sparkSession)
    links = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    links = scratch.stored(links, "links")
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = scratch.stored(_large_star(links, scratch).distinct(), "large")
        links = scratch.stored(_small_star(large, scratch).distinct(), "stars")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return scratch.result(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
