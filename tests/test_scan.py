"""Scans in segments against a loop over each group, and how evenly a hot group is dealt out."""

from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.operators import status as S
from tessera.operators import windows as W


def rows(n=3000, hot=0.9, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        id = "hot" if rng.random() < hot else [None, "a", "b", "c"][rng.integers(4)]
        out.append((id, int(rng.integers(0, n // 3)), i, [None, "dead", "dead", "dead", "live", "unknown"][rng.integers(6)]))
    return out


def by_group(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def plain(data):
    """seq to (before, filled, place, streak) of each row."""
    out = {}
    for group in by_group(data).values():
        last, known, streak = "none", None, 0
        for n, (_, _, seq, status) in enumerate(group, 1):
            known = status if status is not None else known
            streak = 0 if status == "live" else streak + (status == "dead")
            out[seq] = (last, known, n, streak)
            last = status
    return out


def data_of(data, id):
    return [r[2] for r in by_group(data)[id][:1]]


@pytest.mark.parametrize("segments", [1, 3, 40, 500])
def test_scans_equal_a_loop(spark, segments):
    data, by = rows(), (["id"], ["ts", "seq"])
    d, want = spark.createDataFrame(data, "id string, ts int, seq int, status string"), plain(data)
    got = scan.lagged(d, *by, F.col("status"), "old", segments).collect()
    assert len(got) == len(data) and all((r["old"]["v"] if r["old"] else "none") == want[r["seq"]][0] for r in got)
    got = scan.filled(d, *by, F.col("status"), "f", segments).collect()
    assert len(got) == len(data) and all(r["f"] == want[r["seq"]][1] for r in got)
    got = scan.numbered(d, *by, "n", segments).collect()
    assert len(got) == len(data) and all(r["n"] == want[r["seq"]][2] for r in got)
    got = scan.summed(d, *by, {"a": F.lit(1), "b": F.col("seq")}, segments).collect()
    assert len(got) == len(data) and all(r["a"] == want[r["seq"]][2] for r in got) and sum(r["b"] for r in got if r["id"] == "a" and r["a"] == 1) == min(data_of(data, "a"))
    got = scan.summed_since(d, *by, F.when(F.col("status") == "dead", 1).otherwise(0), F.col("status") == "live", "s", segments).collect()
    assert len(got) == len(data) and all(r["s"] == want[r["seq"]][3] for r in got)


def test_groups_without_a_reset_over_many_segments(spark):
    d = spark.createDataFrame([("a", i, "live" if i in (0, 777) else "dead") for i in range(1000)], "id string, ts int, status string")
    got = {r["ts"]: r["s"] for r in scan.summed_since(d, ["id"], ["ts"], F.lit(1), F.col("status") == "live", "s", 50).collect()}
    assert got == {i: i + 1 if i < 777 else i - 776 for i in range(1000)}


def test_empty_and_single_rows(spark):
    d = spark.createDataFrame([("a", 1, "dead")], "id string, ts int, status string")
    assert W.failure_streaks(d).collect()[0]["streak"] == 1 and W.status_changes(d).collect() == []
    for op in (W.failure_streaks, W.status_changes):
        assert op(d.limit(0)).collect() == []
    frames = spark.createDataFrame([("u", 1, [1, 2]), ("u", 2, [3, 5, 9])], "url string, frame_no int, pixels array<int>")
    assert [tuple(r) for r in S.frame_differences(frames).collect()] == [("u", 2, 2.5)] and S.frame_differences(frames.limit(0)).collect() == []


def test_a_hot_group_is_dealt_out(spark):
    """With nine tenths of all rows on one id no task of the last stage has over three times the rows of the middle one."""
    data = spark.createDataFrame(rows(40_000), "id string, ts int, seq int, status string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for out in (W.failure_streaks(data, order=("ts", "seq")), scan.lagged(data, ["id"], ["ts", "seq"], F.col("status"), "old"), W.forward_filled(data, ["id"], "seq", "status", "f")):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 40_000 and max(sizes) <= 3 * median(sizes)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
