"""URL expressions against a plain statement of each rule."""

from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import urls as U


def rows(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def one(spark, values, expr):
    return [r[0] for r in rows(spark, values, expr)]


def test_catalogue_key(spark):
    got = one(
        spark,
        ["http://www.Cam.example/A/?b=2&a=1&UTM_Source=x&a=3#top", "HTTPS://WWW.cam.example/a", "http://h.example", "https://u:p@h.example:80/x//", "http://h.example/?q=a b&e="],
        U.catalogue_key(F.col("u")),
    )
    assert got == ["https://cam.example/a?a=1&b=2", "https://www.cam.example/a", "https://h.example", "https://u:p@h.example:80/x", "https://h.example?e=&q=a+b"]


def test_gate_key(spark):
    got = one(spark, ["", " HTTP://H.Example/A;x/?b=1&utm_id=2&a=2&b=1#f ", "https://h.example", None], U.gate_key(F.col("u")))
    assert got == ["", "http://h.example/A;x?b=1&a=2&b=1", "https://h.example/", ""]


def test_language_prefix(spark):
    got = one(spark, ["http://h.example/en/cam/?x=1", "http://h.example/zh-CN/cam", "http://h.example/eng/cam", "http://h.example/en"], U.language_neutral_key(F.col("u")))
    assert got == ["h.example/cam/?x=1", "h.example/cam", "h.example/eng/cam", "h.example/en"]


def test_unwrap(spark):
    values = ["https://p.example/?src=https%3A%2F%2Fs.example%2Fa.m3u8", "https://p.example/x?u=%2Fa.m3u8", "https://s.example/a.m3u8", "https://p.example/play/http://s.example/b.m3u8?t=1"]
    assert one(spark, values, U.unwrapped(F.col("u"))) == ["https://s.example/a.m3u8", values[1], values[2], "http://s.example/b.m3u8?t=1"]


def test_reject_waterfall_and_predicates(spark):
    values = ["ftp://h.example/a.m3u8", "https://h.example/login/a.m3u8", "https://h.example/authentic-view.m3u8", "https://h.example/a.m3u8?x=login", "https://h.example/a.mp4"]
    assert one(spark, values, U.reject_reason(F.col("u"))) == ["missing_protocol", "auth_url_pattern", "auth_url_pattern", None, "not_hls"]
    got = rows(spark, ["rtsp://h/a.m3u8", "http://h/a.M3U8?x", "http://h/a.m3u8/b"], U.is_stream(F.col("u")), U.is_stream(F.col("u"), "loose"), U.is_stream(F.col("u"), "browser"))
    assert got == [(False, True, True), (True, True, True), (False, True, True)]


def test_buckets(spark):
    values = ["rtsps://h/x", "http://h/a.m3u8?b", "http://h/dash/x", "http://www.youtube.com/embed/1", "http://h/video.mjpg", "http://h/a.mp4", "http://h/snapshot", "http://h/page"]
    assert one(spark, values, U.format_bucket(F.col("u"))) == ["RTSP", ".m3u8", "DASH", "YouTube-only source", "MJPEG", "MP4-only", "JPEG-refresh", "Other/HTML/unknown"]
    assert one(spark, [values[1], values[3], "x://a", "http://h/embed/1", "http://h/v.webm"], U.url_type(F.col("u"))) == ["hls-stream", "youtube-embed", "invalid-protocol", "embed-page", "mp4-file"]
    seen = spark.createDataFrame([("http://h/p", "application/vnd.apple.mpegurl", ""), ("http://h/p", "", "<html>'https://x.example/live.m3u8'"), ("http://h/p", None, "get snapshot"), ("http://h/a.mp4", "image/jpeg", ""), ("http://h/p", None, None)], "u string, t string, b string")
    assert [r[0] for r in seen.select(U.observed_bucket(F.col("u"), F.col("t"), F.col("b"))).collect()] == [".m3u8", ".m3u8", "JPEG-refresh", "MP4-only", "Other/HTML/unknown"]


def test_listing_pages_and_places(spark):
    values = ["http://h/tag/x", "http://h/about", "http://h/cameras/rome/sky", "http://h/cameras/rome/camera/1", "http://h/it/roma/trevi.html", "http://h/a/b/c/about"]
    assert one(spark, values, U.is_listing_page(F.col("u"))) == [True, True, True, False, False, False]
    got = one(spark, ["http://h/en/webcams/italy/lazio/rome/trevi.html", "http://h/italy/rome/", "http://h/rome", "http://h/"], U.geo_hierarchy(F.col("u")))
    assert [tuple(g) for g in got] == [("Italy", "Lazio", "Rome"), ("Italy", None, "Rome"), (None, None, "Rome"), (None, None, None)]


@pytest.mark.parametrize("base", ["http://h.example/a/b/c?q=1", "https://h.example"])
def test_resolution_like_the_standard(spark, base):
    links = ["x.html", "/x", "../x", "./y/../z", "?p=2", "#f", "//o.example/z", "https://o.example/q", "a/./b", "../../../up", "x?y=/../z", "..", "."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(U.resolved(F.col("u"), F.lit(base))).collect()]
    want = [urljoin(base, x) for x in links]
    assert [(g.rstrip("/"), x) for g, x in zip(got, links)] == [(w.rstrip("/"), x) for w, x in zip(want, links)]


names = st.text("abAB-_", min_size=1, max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http", "https"]), names, st.lists(names, max_size=3), st.lists(st.tuples(names, names), max_size=4)), min_size=1, max_size=20))
def test_catalogue_key_rule(spark, parts):
    urls = [f"{s}://{h}.example/{'/'.join(p)}" + ("?" + "&".join(f"{k}={v}" for k, v in q) if q else "") for s, h, p, q in parts]

    def rule(u):
        x = urlsplit(u)
        first = {}
        for k, v in parse_qsl(x.query, keep_blank_values=True):
            if k.lower() not in U.TRACKING_PARAMS:
                first.setdefault(k, v)
        q = "&".join(f"{k}={v}" for k, v in sorted(first.items()))
        return ("https://" + x.netloc.removeprefix("www.") + x.path.rstrip("/") + ("?" + q if q else "")).lower()

    assert one(spark, urls, U.catalogue_key(F.col("u"))) == [rule(u) for u in urls]
