"""Streams in event time with shuffled arrival over several batches, against the batch operators and plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import status as S
from tessera.operators import windows as W
from tessera.streaming import jobs as J

T0 = datetime(2026, 1, 1)


def batches(rows, minutes, seed=1):
    """Rows (key, time, ...) dealt to four batches: late ones, but by less than the delay, and out of order in each."""
    rng = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, minutes)))
    cut = [len(rows) * i // 4 for i in range(5)]
    parts = [arrival[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    for p in parts:
        rng.shuffle(p)
    assert any(min(r[1] for r in b) < max(r[1] for r in a) for a, b in zip(parts, parts[1:], strict=False))
    return parts


def streamed(spark, tmp_path, parts, schema, job):
    """What a job has written after it was started anew for each batch."""
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        J.run_to_end(job(J.read_stream(spark, src, schema, fmt="parquet")), out, state)
    return spark.read.parquet(out)


def ends(rows):
    """Rows far later, in a batch of their own, that bring the watermark past all others."""
    return [("zz-last", max(r[1] for r in rows) + timedelta(days=2 + i), *rows[0][2:]) for i in range(2)]


def test_late_checks_take_their_place(spark, tmp_path):
    """The case that order within a batch gets wrong: dead at 1 and 3, then live at 2 in the next batch."""
    schema = "id string, ts timestamp, seq long, status string"
    check = lambda m, s: ("a", T0 + timedelta(minutes=m), m, s)
    parts = [[check(1, "dead"), check(3, "dead")], [check(2, "live"), check(4, "dead")]]
    got = streamed(spark, tmp_path, [*parts, ends(parts[0])], schema, J.health_states).where("id = 'a'").orderBy("ts").collect()
    assert [(r["checks"], r["streak"], r["old_status"]) for r in got] == [(1, 1, None), (2, 0, "dead"), (3, 1, "live"), (4, 2, "dead")]


def test_health_states_equal_windows(spark, tmp_path):
    rng, schema = random.Random(2), "id string, ts timestamp, seq long, status string"
    rows = [(f"r{rng.choice([0, 0, 0, 1, 2])}", T0 + timedelta(minutes=rng.randrange(200)), i, rng.choice(["dead", "dead", "dead", "live", "unknown"])) for i in range(240)]
    got = streamed(spark, tmp_path, [*batches(rows, 25), ends(rows)], schema, lambda d: J.health_states(d, threshold=2, delay="30 minutes"))
    d = spark.createDataFrame(rows, schema)
    by = ("ts", "seq")
    want = W.failure_streaks(d, order=by).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*by)))
    want = {(r["id"], r["n"]): (r["streak"], r["status"], r["streak"] >= 2, r["ts"]) for r in want.collect()}
    assert {(r["id"], r["checks"]): (r["streak"], r["status"], r["review"], r["ts"]) for r in got.where("id <> 'zz-last'").collect()} == want
    changes = sorted((r["id"], r["ts"], r["status"], r["old_status"]) for r in W.status_changes(d, order=by).collect())
    assert sorted((r["id"], r["ts"], r["status"], r["old_status"]) for r in got.where("changed and id <> 'zz-last'").collect()) == changes


def test_playlist_states_equal_windows(spark, tmp_path):
    rng, schema = random.Random(3), "url string, taken_at timestamp, body string"
    head = lambda: rng.choice(["", "#EXT-X-MEDIA-SEQUENCE:4\n", "#EXT-X-MEDIA-SEQUENCE:5\n", f"#EXT-X-MEDIA-SEQUENCE:{rng.randrange(9)}\n"])
    times = rng.sample(range(300), 120)
    rows = [(f"u{i % 4}", T0 + timedelta(minutes=t), head() + rng.choice(["a.ts", "b.ts", "a.ts\nb.ts"]) + rng.choice(["", "", "", "\n#EXT-X-ENDLIST"])) for i, t in enumerate(times)]
    got = streamed(spark, tmp_path, [*batches(rows, 25), ends(rows)], schema, lambda d: J.playlist_states(d, delay="30 minutes"))
    told = lambda d: sorted(((r["url"], r["taken_at"], r["classification"], r["sequence_delta"]) for r in d.where("url <> 'zz-last'").collect()), key=str)
    assert told(got) == told(S.playlist_classes(spark.createDataFrame(rows, schema)))


def beats(rows, every, hits_wanted, grace):
    """The beats of one run by a loop."""
    out, lines, hits, stage, counters, stop, first = {}, 0, 0, None, {}, None, None
    for _, at, _, text in sorted(rows, key=lambda r: r[1:3]):
        first, lines, hit = first or at, lines + 1, "Texas" in text
        hits += hit
        told = {"Probing urls": "validation", "crawling": "directory-crawl", "GeoJSON": "catalog-map", "ValidationAgent": "validation"}
        stage = next((s for word, s in told.items() if word in text), stage)
        if "features" in text:
            counters["geojson_features_written"] = counters.get("geojson_features_written", 0) + int(text.split()[1])
            counters["geojson_features_skipped"] = counters.get("geojson_features_skipped", 0) + 1
        if "candidates received" in text:
            counters["validation_candidates_received"] = int(text.split()[1])
        if stop is None and hit and hits >= hits_wanted and (at - first).total_seconds() >= grace:
            stop = at
        end = T0 + every * ((at - T0) // every + 1)
        out[end] = (stage, lines, hits, dict(counters), stop)
    return out


def test_heartbeat_tells_stage_counters_and_stop(spark, tmp_path):
    rng, schema = random.Random(4), "run string, logged_at timestamp, seq long, text string"
    words = lambda i: rng.choice(["Probing urls", "crawling x", "nothing", "Probing in Texas", f"GeoJSONExportSkill: {i} features written, 1 skipped", f"ValidationAgent: {i} candidates received"])
    rows = [(f"run{i % 2}", T0 + timedelta(minutes=rng.randrange(300), seconds=i % 60), i, words(i)) for i in range(200)]
    job = lambda d: J.heartbeat(d, every_seconds=600, delay="30 minutes", leaks="(?i)texas", stop_hits=4, grace_seconds=3600)
    got = streamed(spark, tmp_path, [*batches(rows, 25), ends(rows)], schema, job).where("run <> 'zz-last'").collect()
    for run in ("run0", "run1"):
        want = beats([r for r in rows if r[0] == run], timedelta(minutes=10), 4, 3600)
        assert any(stop for *_, stop in want.values())
        assert {r["beat"]: (r["stage"], r["lines"], r["hits"], r["counters"], r["stop_at"]) for r in got if r["run"] == run} == want
        assert all(r["stop"] == (r["stop_at"] is not None) for r in got)


def test_keys_share_calls_of_the_state_store(spark, tmp_path):
    """State lies by parts of keys: with 4,000 keys its rows are bounded by the parts, and each key's checks are told in order."""
    from tessera.streaming import ordered

    schema = "id string, ts timestamp, seq long, status string"
    rows = [(f"k{i % 4000}", T0 + timedelta(minutes=i // 4000), i, "dead") for i in range(8000)]
    spark.createDataFrame([*rows[4000:], *rows[:4000], *ends(rows)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    states = J.health_states(J.read_stream(spark, f"{tmp_path}/in", schema, fmt="parquet"))
    query = states.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6 * ordered.PARTS < 4000
    got = spark.read.parquet(f"{tmp_path}/out").where("id <> 'zz-last'").collect()
    assert len(got) == 8000 and all((r["checks"], r["streak"]) == ((1, 1) if r["ts"] == T0 else (2, 2)) for r in got)
