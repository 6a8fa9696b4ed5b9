import json
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.sources import files as S
from tessera.streaming import jobs as J


def test_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text('{"url":"https://www.x.example/1","n":0}\n\nbroken\n[1]\n{"url":"","page_url":"https://y.example"}\n')
    t = S.read_jsonl_tolerant(spark, str(tmp_path / "logs"), numbered=True).orderBy("_line").collect()
    assert [(r["_line"], r["_raw"]) for r in t] == [(1, None), (3, "broken"), (4, "[1]"), (5, None)]
    assert sorted(r["domain"] or "" for r in S.read_artifacts(spark, str(tmp_path)).collect()) == ["", "", "x.example", "y.example"]
    assert S.read_jsonl(spark, str(tmp_path / "logs"), "url string, n int").where("n = 0").count() == 1
    doc = spark.createDataFrame([('{"a":{"b":1,"c":[1,2]},"d":null,"e":"x"}',)], "j string").select(F.try_parse_json("j").alias("doc"))
    got = {r["key"]: r["value"] for r in S.flattened(doc).collect()}
    assert got["a.b"] == "1" and got["a.c.len"] == "2" and got["e"] == "x"


def test_geojson(spark, tmp_path):
    rows = spark.createDataFrame([("1", "http://a", "live", 90.0, -180.0), ("2", "http://b", "other", None, 1.0)], "id string, url string, status string, latitude double, longitude double")
    S.write_geojson(rows, str(tmp_path / "g"), "now")
    meta = spark.read.json(str(tmp_path / "g" / "metadata")).first()
    assert (meta["total"], meta["live"], meta["dead"], meta["unknown"], meta["unmapped"]) == (2, 1, 0, 1, 1)
    feature = json.loads(spark.read.text(str(tmp_path / "g" / "features")).first()[0])
    assert feature["geometry"] == {"type": "Point", "coordinates": [-180.0, 90.0]} and feature["properties"]["id"] == "1"
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {"geometry": {"coordinates": [0, 90.0001]}, "properties": {"id": "3", "url": "u"}}, {}]}))
    good, bad = S.read_geojson(spark, str(tmp_path / "x.json"))
    assert [(r["id"], r["latitude"]) for r in good.collect()] == [("1", 90.0)] and bad.count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Europe", "Italy", "Rome", "b", "u", "live", "HLS", None), ("Europe", "Italy", "Rome", "a", "u", "live", "HLS", None)], "continent string, country string, city string, label string, url string, status string, feed_type string, notes string")
    S.write_grouped(rows, str(tmp_path / "g"))
    assert [i["label"] for i in spark.read.json(str(tmp_path / "g")).first()["items"]] == ["a", "b"]
    S.write_snapshot(rows, str(tmp_path / "s"), "2026-01-01")
    S.write_snapshot(rows.limit(1), str(tmp_path / "s"), "2026-01-01")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    S.append_jsonl(rows.limit(0), str(tmp_path / "l"))
    assert not (tmp_path / "l").exists()
    S.append_jsonl(rows, str(tmp_path / "l"))
    S.append_jsonl(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    S.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    a = spark.createDataFrame([(1, "http://x/a.m3u8"), (2, "http://x/p")], "seq int, url string")
    b = spark.createDataFrame([(3, "http://x/a.m3u8", "q"), (4, "http://x/p", "q")], "seq int, url string, query string")
    streams, rest = S.split_candidates(a, b)
    assert [r["seq"] for r in streams.collect()] == [1] and [r["seq"] for r in rest.collect()] == [2]
    assert S.split_candidates(a, b, both_distinct=False)[0].count() == 2


def test_dedup_and_fork(spark, tmp_path):
    src = str(tmp_path / "in")
    for urls in (["http://x/a.m3u8", "http://x/p", "http://x/a.m3u8"], ["http://x/p", "http://x/b.m3u8"]):
        spark.createDataFrame([(u,) for u in urls], "url string").write.mode("append").json(src)
        J.fork(J.new_urls(J.read_stream(spark, src, "url string")), str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["http://x/a.m3u8", "http://x/b.m3u8"]
    assert [r["url"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["http://x/p"]


def test_windowed_lines(spark):
    d = spark.createDataFrame([("Probing URLs in Texas", datetime(2026, 1, 1, 0, 0, 5)), ("crawling", datetime(2026, 1, 1, 0, 2))], "text string, logged_at timestamp")
    beats = J.windowed_lines(d, leaks="(?i)texas")
    assert sorted((r["stage"], r["lines"], r["leaks"]) for r in beats.collect()) == [("directory-crawl", 1, 0), ("validation", 1, 1)]
    assert J.alerts(beats, 0).count() == 1
