"""First and last wins, caps, streaks, changes and batches: operators over an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import scan


def first_wins(rows: DataFrame, key: Sequence[str], order: str = "seq") -> DataFrame:
    """The earliest row of each key; combined before the shuffle, so a hot key is no hot task."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_one"))
    return best.select(*key, *[F.col(f"_one.{c}").alias(c) for c in others])


def last_wins(rows: DataFrame, key: Sequence[str], order: str = "seq") -> DataFrame:
    """The latest row of each key, at the place where the key first came."""
    others = [c for c in rows.columns if c not in (*key, order)]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_one"), F.min(order).alias(order))
    return best.select(*key, order, *[F.col(f"_one.{c}").alias(c) for c in others])


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def top_counts(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n commonest values, ties in the order they first came."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def shallow_links(links: DataFrame, n: int = 10) -> DataFrame:
    """Of each page the n links of the least depth, in page order."""
    return top_per_group(links, ["page"], ["depth", "pos"], n)


def numbered_batches(rows: DataFrame, order: Sequence[str], size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the first `most` batches with batch from 1, the rest). Only size * most rows are ranked."""
    taken = rows.orderBy(*order).limit(size * most)
    numbered = taken.withColumn("batch", F.ceil(F.row_number().over(Window.orderBy(*order)) / size).cast("int"))
    return numbered, rows.join(taken.select(*order), list(order), "left_anti")


def keep_last(rows: DataFrame, group: Sequence[str], order: str, value: str, k: int) -> DataFrame:
    """(group, last_values): the last k values of each group in order."""
    kept = top_per_group(rows, group, [F.desc(order)], k)
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return kept.groupBy(*group).agg(F.transform(pairs, lambda p: p[value]).alias("last_values"))


def failure_streaks(log: DataFrame, id: str = "id", status: str = "status", order: Sequence[str] = ("ts",), unknown_resets: bool = False) -> DataFrame:
    """Add streak: failures in a row up to each check. dead adds one, live starts anew; unknown leaves it, or resets it if asked."""
    resets = (F.col(status) == "live") | ((F.col(status) == "unknown") if unknown_resets else F.lit(False))
    return scan.summed_since(log, [id], order, F.when(F.col(status) == "dead", 1).otherwise(0), resets, "streak")


def review_queue(streaks: DataFrame, threshold: int = 4) -> DataFrame:
    """Checks whose streak has reached the threshold: queued at each of them."""
    return streaks.where(F.col("streak") >= threshold)


def status_changes(log: DataFrame, id: str = "id", status: str = "status", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Checks whose status differs from the one before, with old_status."""
    old = scan.lagged(log, [id], order, F.col(status), "old_status").withColumn("old_status", F.col("old_status.v"))
    return old.where(F.col("old_status") != F.col(status))


def forward_filled(rows: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Add the last value up to each row that isn't null."""
    return scan.filled(rows, group, [order], F.col(value), out)


def latest_metrics(rows: DataFrame, run: str, order: str, last: Sequence[str] = (), summed: Sequence[str] = ()) -> DataFrame:
    """Per run the last known value of some metrics and the sum of others."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last] + [F.sum(c).alias(c) for c in summed]
    return rows.groupBy(run).agg(*aggs)


def catalogue_order(rows: DataFrame, columns: Sequence[str] = ("country", "region", "city", "label")) -> DataFrame:
    """Rows by place and label, unknown places first. A sort by ranges: written, the files follow each other."""
    return rows.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
