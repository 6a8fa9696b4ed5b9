"""GeoJSON collections against json.loads: any layout, in many blocks, cut short, broken."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S


def feature(rng, i):
    odd = rng.choice(["plain", 'a "quoted" {brace', "back\\slash}", "]}{[", "é🙂", "", 'ends in a backslash \\', "line\nbreak", '"features": [{'])
    return {
        "type": "Feature",
        "geometry": {"type": "Point", "coordinates": [rng.uniform(-180, 180), rng.uniform(-90, 90)]},
        "properties": {"id": str(i), "url": f"http://x/{i}", "label": odd, "notes": {"deep": [{"a": {}}, [], {"b": odd}]}, "status": "live"},
    }


def ids(frame):
    return sorted(int(r["id"]) for r in frame.collect())


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, "900")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_any_layout_in_many_blocks(spark, tmp_path, small_blocks, indent):
    rng = random.Random(indent or 0)
    some = [feature(rng, i) for i in range(60)]
    whole = [
        {"type": "FeatureCollection", "features": some[:20], "metadata": {"total": 20, "list": [{"id": "no"}, {"id": "no"}]}},
        {"metadata": {"a": {"b": 1}}, "other": [feature(rng, 900), feature(rng, 901)], "features": some[20:40], "more": [feature(rng, 902), {"features": [feature(rng, 903)]}, feature(rng, 904)], "type": "FeatureCollection"},
        {"type": "FeatureCollection", "features": []},
        {"features": [], "other": [feature(rng, 905), feature(rng, 906)]},
        {"features": some[40:]},
    ]
    for n, c in enumerate(whole):
        (tmp_path / f"{n}.json").write_text(json.dumps(c, indent=indent, ensure_ascii=n % 2 == 0) + "\n" * (n % 2))
    good, bad = S.read_geojson(spark, str(tmp_path))
    assert ids(good) == list(range(60)) and bad.count() == 0
    assert {r["id"]: (r["label"], r["latitude"]) for r in good.collect()} == {f["properties"]["id"]: (f["properties"]["label"], f["geometry"]["coordinates"][1]) for f in some}
    # one file is read by several tasks
    one = spark.read.option("lineSep", "}").text(str(tmp_path / "1.json"))
    assert one.select(F.spark_partition_id()).distinct().count() > 3


def test_cut_short_at_every_place(spark, tmp_path):
    """However a file is cut, its whole features stay and what is left of the last one is a bad row."""
    rng = random.Random(3)
    some = [feature(rng, i) for i in range(4)]
    text = json.dumps({"type": "FeatureCollection", "features": some})
    ends, at = [], 0
    for f in some:
        at = text.index(json.dumps(f), at) + len(json.dumps(f))
        ends.append(at)
    cuts = sorted({ends[1] + 30, *range(30, len(text), 41), *ends, *(e - 1 for e in ends), *(e - 2 for e in ends)})
    for c in cuts:
        (tmp_path / f"{c}.json").write_text(text[:c])
    units = S.geojson_units(spark, str(tmp_path)).select(F.regexp_extract("artifact", r"(\d+)\.json", 1).cast("int").alias("c"), "whole", "text").collect()
    for c in cuts:
        mine = [u for u in units if u["c"] == c]
        assert sorted(u["text"] for u in mine if u["whole"]) == sorted(json.dumps(f) for f, e in zip(some, ends, strict=True) if e <= c), c
        begun = sum(text[:c].count('{"type": "Feature",') for _ in "x") - sum(e <= c for e in ends)
        assert sum(not u["whole"] for u in mine) >= begun and len(mine) <= 5
    good, bad = S.read_geojson(spark, str(tmp_path / f"{ends[1] + 30}.json"))
    assert ids(good) == [0, 1] and bad.count() == 1


def test_bad_features_and_empty_folders(spark, tmp_path):
    rng = random.Random(4)
    odd = [{"type": "Feature"}, {"geometry": {"coordinates": [0, 90.001]}, "properties": {"id": "9", "url": "u"}}]
    (tmp_path / "a.json").write_text(json.dumps({"features": [feature(rng, 1), *odd, feature(rng, 2)]}).replace('"9"', '"9" oops'))
    good, bad = S.read_geojson(spark, str(tmp_path))
    assert ids(good) == [1, 2] and bad.count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "empty.json").write_text("")
    assert [x.count() for x in S.read_geojson(spark, str(tmp_path / "b"))] == [0, 0]
