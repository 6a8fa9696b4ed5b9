"""Scans over the rows of a group in order, for groups of any size.

Rows are range-partitioned by group and order into segments, so a group that holds most of all rows spreads over many.
Within a segment, windows do the work; what a group hands from one segment to the next is a summary of a row. Only the
first group of a segment can have begun before it, so there are at most as many carries as segments, and they go to all
tasks. Rows of one group that agree in all order columns stay together; give columns that tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.storage import stored

SEGMENT, CARRY = "_segment", "_carry"
#: Segments for each shuffle partition: more than one, so that a hot group's are dealt out evenly.
FINER = 4


def cut(rows: DataFrame, group: Sequence[str], order: Sequence[str], segments: int | None = None, store: Callable = stored) -> DataFrame:
    """rows with their segment, written by `store`: the bounds come from a sample, so they must be drawn once only."""
    n = segments or FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return store(rows.repartitionByRange(n, *group, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def within(group: Sequence[str], order: Sequence[str]):
    """The rows of a group in one segment up to each row."""
    return Window.partitionBy(SEGMENT, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _given(rows: DataFrame, group: Sequence[str], carries: DataFrame) -> DataFrame:
    """rows with the carry of their group and segment, null where there is none."""
    names = [f"_g{i}" for i in range(len(group))]
    carries = carries.select(F.col(SEGMENT).alias("_s"), *[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], CARRY)
    same = rows[SEGMENT] == F.col("_s")
    for g, n in zip(group, names, strict=True):
        same &= rows[g].eqNullSafe(F.col(n))
    return rows.join(F.broadcast(carries), same, "left").drop("_s", *names)  # a row for each segment at most


def carried(rows: DataFrame, group: Sequence[str], summary: dict[str, Column], handed: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """rows with what the segments before hand to their group; null where it begins in this segment.

    summary: aggregates of a group's rows in a segment. handed: adds the carry to these, given a window over a
    group's segments before the present one.
    """
    per = rows.groupBy(SEGMENT, *group).agg(*[c.alias(name) for name, c in summary.items()])
    before = Window.partitionBy(*group).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_first", F.min(SEGMENT).over(before))
    return _given(rows, group, handed(per, before).where(F.col("_first").isNotNull()))


def lagged(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, segments: int | None = None, store: Callable = stored) -> DataFrame:
    """Add struct `out`(v): the value of the row before in the group, null for the first row; v may be null itself."""
    spread = cut(rows.withColumn(out, F.struct(value.alias("v"))), group, order, segments, store)
    local = F.lag(out).over(Window.partitionBy(SEGMENT, *group).orderBy(*order))
    spread = carried(spread, group, {"_end": F.max_by(out, F.struct(*order))}, lambda per, before: per.withColumn(CARRY, F.last("_end").over(before)))
    return spread.withColumn(out, F.coalesce(local, F.col(CARRY))).drop(SEGMENT, CARRY)


def filled(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, segments: int | None = None, store: Callable = stored) -> DataFrame:
    """Add the last value up to each row that isn't null."""
    spread = cut(rows.withColumn(out, value), group, order, segments, store)
    latest = F.max_by(out, F.when(F.col(out).isNotNull(), F.struct(*order)))
    spread = carried(spread, group, {"_end": latest}, lambda per, before: per.withColumn(CARRY, F.last("_end", ignorenulls=True).over(before)))
    return spread.withColumn(out, F.coalesce(F.last(out, ignorenulls=True).over(within(group, order)), CARRY)).drop(SEGMENT, CARRY)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], out: str, segments: int | None = None, store: Callable = stored) -> DataFrame:
    """Add the place of each row in its group, from 1."""
    spread = cut(rows, group, order, segments, store)
    spread = carried(spread, group, {"_n": F.count("*")}, lambda per, before: per.withColumn(CARRY, F.sum("_n").over(before)))
    return spread.withColumn(out, F.row_number().over(within(group, order)) + F.coalesce(CARRY, F.lit(0))).drop(SEGMENT, CARRY)


def summed(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column], segments: int | None = None, store: Callable = stored) -> DataFrame:
    """Add the running sums of integer values, by the columns that they make."""
    spread = cut(rows.withColumns(values), group, order, segments, store)
    sums = {c: F.sum(c) for c in values}
    spread = carried(spread, group, sums, lambda per, before: per.withColumn(CARRY, F.struct(*[F.sum(c).over(before).alias(c) for c in values])))
    up_to = within(group, order)
    return spread.withColumns({c: F.sum(c).over(up_to) + F.coalesce(F.col(f"{CARRY}.{c}"), F.lit(0)) for c in values}).drop(SEGMENT, CARRY)


def running(spread: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the running sum of an integer column to rows that cut() has dealt out; they stay so for more of the kind."""
    spread = carried(spread, group, {"_n": F.sum(value)}, lambda per, before: per.withColumn(CARRY, F.sum("_n").over(before)))
    return spread.withColumn(out, F.sum(value).over(within(group, order)) + F.coalesce(CARRY, F.lit(0))).drop(CARRY)


def summed_since(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, resets: Column, out: str, segments: int | None = None, store: Callable = stored) -> DataFrame:
    """Add the sum of an integer value over the rows since the last one that resets it, that row included; from the group's start if none did."""
    spread = cut(rows.withColumns({"_value": value.cast("bigint"), "_reset": F.coalesce(resets, F.lit(False))}), group, order, segments, store)
    spread = spread.withColumn("_run", F.count_if("_reset").over(within(group, order)))
    # of a segment: whether it resets the sum, and the sum since its last reset
    per_run = spread.groupBy(SEGMENT, *group, "_run").agg(F.sum("_value").alias("_sum"))
    tails = per_run.groupBy(SEGMENT, *group).agg(F.max_by("_sum", "_run").alias("_tail"), F.max("_run").alias("_resets"))
    tails = tails.withColumn("_runs", F.sum("_resets").over(Window.partitionBy(*group).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # segments without a reset go on with the run of the one before: their sums add up from the last that has one
    since = Window.partitionBy(*group, "_runs").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tails.withColumn("_after", F.sum("_tail").over(since))
    step = Window.partitionBy(*group).orderBy(SEGMENT)
    tails = tails.withColumns({CARRY: F.lag("_after").over(step), "_n": F.row_number().over(step)}).where(F.col("_n") > 1)
    joined = _given(spread, group, tails)
    local = F.sum("_value").over(Window.partitionBy(SEGMENT, *group, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn(out, local + F.when(F.col("_run") == 0, F.coalesce(CARRY, F.lit(0))).otherwise(0)).drop(SEGMENT, CARRY, "_value", "_reset", "_run")
