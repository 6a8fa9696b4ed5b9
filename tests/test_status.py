import math

from tessera.operators import status as S


def test_chain(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("never",)], "url string")
    probes = spark.createDataFrame(
        [("a", "dead", "low", "http_404", 1), ("a", "live", "high", None, 2), ("b", "dead", "low", "x", 1), ("s", "live", "high", None, 1), ("c", "live", "high", None, 1), ("d", "live", "high", None, 1)],
        "url string, status string, legitimacy_score string, fail_reason string, probed_at int",
    )
    stream_map = spark.createDataFrame([("b", "s"), ("b", "zz")], "page_url string, stream_url string")
    offline = spark.createDataFrame([("c",), ("c",)], "page_url string")
    playlists = spark.createDataFrame([("d", "vod_playlist"), ("a", "live_playlist")], "url string, classification string")
    frames = spark.createDataFrame([("a", "unknown", "frozen_frames"), ("b", None, None)], "url string, frame_status string, detail string")
    got = {r["url"]: (r["status"], r["fail_reason"]) for r in S.resolve(c, probes, stream_map, offline, frames, playlists).collect()}
    assert got == {"a": ("unknown", "frozen_frames"), "b": ("live", None), "d": ("unknown", "playlist:vod_playlist")}
    assert {r["url"] for r in S.resolve(c, probes, stream_map, offline, None, playlists).collect()} == {"a", "b"}


def test_frames(spark):
    dark, grey = [0] * 10, [100] * 10
    rows = [("blank", i, dark) for i in range(3)] + [("frozen", i, [50, 200] * 5) for i in range(3)] + [("moves", i, [i * 40, 90]) for i in range(3)] + [("single", 0, grey), ("none", 0, [])]
    f = spark.createDataFrame(rows, "url string, frame_no int, pixels array<smallint>")
    got = {r["url"]: (r["frame_status"], r["detail"]) for r in S.frame_verdicts(f).collect()}
    assert got == {"blank": ("unknown", "blank_or_dark_frames"), "frozen": ("unknown", "frozen_frames"), "moves": ("live", "frames_ok"), "single": ("live", "frames_ok"), "none": (None, None)}
    m = {(r["url"], r["frame_no"]): r for r in S.frame_metrics(f).collect()}
    assert m["frozen", 0]["entropy"] == 1.0 and m["frozen", 0]["std"] == 75.0 and m["none", 0]["dark_share"] == 1.0
    x = m["moves", 1]
    assert math.isclose(x["mean"], 65.0) and x["entropy"] == 1.0
    growing = spark.createDataFrame([("frozen", True)], "url string, changed boolean")
    v = {r["url"]: (r["status"], r["substatus"]) for r in S.visual_verdicts(f, growing).collect()}
    assert v["frozen"] == ("unknown", "active_prerecorded_loop_short") and v["blank"] == ("unknown", "decode_failed") and v["moves"] == ("live", "active_live_dynamic") and v["none"] == ("unknown", "decode_failed")


def test_playlists(spark):
    head = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:{}\na{}.ts\n"
    rows = [("live", 1, head.format(1, 1)), ("live", 2, head.format(2, 2)), ("same", 1, head.format(1, 1)), ("same", 2, head.format(1, 1)), ("end", 1, head.format(1, 1)), ("end", 2, head.format(2, 2) + "#EXT-X-ENDLIST"), ("odd", 1, "x.ts"), ("odd", 2, "x.ts"), ("once", 1, "x")]
    got = {r["url"]: r["classification"] for r in S.playlist_classes(spark.createDataFrame(rows, "url string, taken_at int, body string")).collect()}
    assert got == {"live": "live_playlist", "same": "static_playlist", "end": "vod_playlist", "odd": "unknown_playlist"}
