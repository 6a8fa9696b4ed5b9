from tessera.operators import extract as E

PAGE = """<html><a href="/cams/x.html">One <b>cam</b></a><a href='next?page=2'>Next</a><a href="https://o.example/z">out</a>
<video><source src="//cdn.example/live/a.m3u8"></video><script>var hlsUrl = "https:\\/\\/cdn.example\\/b.m3u8?t=1";</script>
<div data-stream="c.m3u8"></div><iframe src="https://player.youtube.com/x"></iframe><iframe src="/frame"></iframe>"""


def pages(spark):
    return spark.createDataFrame([("http://h.example/it/roma/", PAGE), ("http://h.example/frame", "<video src='/f.m3u8'>"), ("http://h.example/none", "<iframe src='/frame'></iframe>"), ("http://n.example", None)], "url string, html string")


def test_stream_links(spark):
    got = {r["url"]: r["embedded"] for r in E.stream_links(pages(spark)).collect()}
    assert got["http://h.example/it/roma/"] == ["http://cdn.example/live/a.m3u8", "https://cdn.example/b.m3u8?t=1", "http://h.example/it/roma/c.m3u8"]
    assert got["http://h.example/none"] == [] and got["http://n.example"] == []


def test_expansion(spark):
    c = spark.createDataFrame([(1, "http://h.example/it/roma/", ["d"], None, "Lazio"), (2, "http://q.example/", None, "n", None)], "seq int, url string, source_refs array<string>, notes string, state_region string")
    got = sorted((r["seq"], r["url"], r["source_refs"], r["notes"], r["state_region"]) for r in E.expand_candidates(c, pages(spark)).collect())
    assert got[0] == (1, "http://cdn.example/live/a.m3u8", ["d", "http://h.example/it/roma/"], None, "Lazio")
    assert got[1][3] == "embedded_in:http://h.example/it/roma/" and got[1][4] is None
    assert got[3] == (2, "http://q.example/", None, "n", None)


def test_links(spark):
    got = {(r["link"], r["text"], r["depth"]) for r in E.same_domain_links(pages(spark)).collect()}
    assert got == {("http://h.example/cams/x.html", "One cam", 2), ("http://h.example/it/roma/next?page=2", "Next", 3)}
    assert [r["link"] for r in E.pagination_links(pages(spark)).collect()] == ["http://h.example/it/roma/next?page=2"]
    assert [r["link"] for r in E.same_domain_links(pages(spark), city="Cam").collect()] == ["http://h.example/cams/x.html"]


def test_frames(spark):
    assert [tuple(r) for r in E.frame_streams(pages(spark)).collect()] == [("http://h.example/none", "http://h.example/frame", "http://h.example/f.m3u8")]


def test_feeds(spark):
    texts = spark.createDataFrame([(2, "see https://f.example/a.geojson and https://g.example/x/MapServer/3"), (1, "https://f.example/z.json host.example"), (3, None)], "seq int, text string")
    got = [r["endpoint"] for r in E.feed_endpoints(texts, synthetic=("host.example", ["https://h.example/d1.json"])).collect()]
    assert got == ["https://f.example/z.json", "https://h.example/d1.json", "https://f.example/a.geojson", "https://g.example/x/MapServer/3"]
    bodies = [
        ("a", '{"features":[{"properties":{"name":"","title":"T","id":7,"urls":[{"u":"https://s.example/1.m3u8"}]},"geometry":{"coordinates":[1.5,2.5]}}]}'),
        ("b", '[{"camera_name":"B","lat":"3","lon":4,"url":"https://s.example/2.m3u8"},{"name":"no stream"}]'),
        ("c", "not json"),
        ("d", '{"features":[],"cameras":[{"stream":"x.m3u8"}]}'),
    ]
    got = [tuple(r)[:7] for r in E.feed_records(spark.createDataFrame(bodies, "endpoint string, body string")).collect()]
    assert got == [("a", 0, "https://s.example/1.m3u8", "T", "7", 2.5, 1.5), ("b", 0, "https://s.example/2.m3u8", "B", None, 3.0, 4.0), ("d", 0, "x.m3u8", None, None, None, None)]
    assert E.feed_candidates(E.feed_records(spark.createDataFrame(bodies, "endpoint string, body string")), "p").first()["source_refs"] == ["a", "p"]


def test_scripts_and_playlists(spark):
    s = spark.createDataFrame([("https://h.example/js/a.js", "x='/live/a.m3u8'; fetch('/api/v1/list'); y=\"https://h.example/GetCameras\"")], "script_url string, body string")
    assert {(r["kind"], r["endpoint"]) for r in E.script_endpoints(s).collect()} == {("stream", "https://h.example/live/a.m3u8"), ("api", "https://h.example/api/v1/list"), ("api", "https://h.example/GetCameras")}
    p = spark.createDataFrame([("https://h.example/m/x.m3u8", "#EXTM3U\n#EXT-X-STREAM-INF:A\n#note\nlow.m3u8\n#EXT-X-STREAM-INF:B\nhttps://o.example/h.m3u8\n#EXT-X-STREAM-INF:C\nlow.m3u8\n"), ("e", None)], "url string, body string")
    assert [r["variant"] for r in E.playlist_variants(p).orderBy("n").collect()] == ["https://h.example/m/low.m3u8", "https://o.example/h.m3u8"]


def test_url_metadata(spark):
    d = spark.createDataFrame([("https://h.example/live/timesSquare-north1/index.m3u8?city=New%20York",), ("https://h.example/live/",)], "url string")
    a, b = E.url_metadata(d).collect()
    assert a["technical_tokens"] == ["index", "live"]
    assert ("Times Square", "high") in [tuple(p) for p in a["location_phrases"]] and b["label_hint"] is None


def test_targets(spark):
    q = spark.createDataFrame([(1, "cams from Pennsylvania and near Rome; Oslo", ["rome", "Bergen"]), (2, "find m3u8 feeds", None), (3, "https://a.example/x b.example 10.0.0.1 1.5,-2.5", None), (4, None, None)], "query_id int, query string, planned array<string>")
    got = {}
    for r in E.target_indicators(q, planned="planned").collect():
        got.setdefault(r["id"], set()).add((r["type"], r["name"], r["confidence"]))
    assert got[1] == {("place", "Rome", 0.7), ("place", "Oslo", 0.7), ("place", "Bergen", 0.75)} and 2 not in got and 4 not in got
    assert {("url", "a.example", 0.95), ("hostname", "b.example", 0.8), ("ip", "10.0.0.1", 0.8), ("coordinates", "1.5,-2.5", 0.9)} <= got[3]


def test_logs(spark):
    lines = [
        "ValidationAgent: 1,204 candidates received from https://www.A.example/x, probing urls",
        "Visual frame analysis", "", None,
        "DirectoryTraversalSkill: 12 candidates from b.example (3 pages)", "DirectoryTraversalSkill: 1,000 candidates from b.example (7 pages)",
        "b.example: 5 stream(s) found", "b.example: 9 stream(s) found", "reading from c.example (x)", "now crawling d.example",
        "probe results — live=1, dead=2, unknown=3, timeout=4, other=5", "collapsed 7 rows (20 → 13)", "see http://e.example/cam1.m3u8 and http://e.example/p",
    ]
    d = spark.createDataFrame(list(enumerate(lines)), "seq int, text string")
    rows = {r["seq"]: r for r in E.log_lines(d).collect()}
    assert [rows[i]["stage"] for i in range(6)] == ["validation", "visual-analysis", None, None, "directory-crawl", "directory-crawl"]
    assert [rows[i]["domain"] for i in (0, 1, 3, 4, 8, 9)] == ["www.a.example", "unknown", "unknown", "b.example", "c.example", "d.example"]
    assert rows[0]["validation_candidates_received"] == 1204 and rows[10]["probe_other"] == 5 and rows[11]["candidates_after_collapse"] == 13 and rows[1]["mapped"] is None
    assert [tuple(r) for r in E.domain_metrics(d).collect()] == [("b.example", 1012, 10, 9)]
    counts, recent = E.url_domains(d)
    assert {tuple(r) for r in counts.collect()} == {("www.a.example", 1), ("e.example", 2)}
    assert [r["url"] for r in recent.collect()] == ["http://e.example/cam1.m3u8"]
    assert [r["url"] for r in E.harvested_urls(spark.createDataFrame([("a https://x.example/live/1 https://x.example/p",), (None,)], "t string"), "t").collect()] == ["https://x.example/live/1"]


def test_log_lines_cost_little(spark, capsys):
    """A line is flattened once, not for each pattern, and a pattern is asked only where its word stands."""
    lines = ["custom query of a search", "searching a QUERY", "Scope inference by ScopeEnforcementAgent", "analysis, visual", "visual", "HTTPX.ReadTimeout", "httpxxreadtimeout", "map.html", "mapshtml", "5 Stream(s) found", "a" * 499 + " crawling", "search\nquery"]
    d = spark.createDataFrame(list(enumerate(lines)), "seq int, text string")
    got = [r["stage"] for r in E.log_lines(d).orderBy("seq").collect()]
    assert got == ["search", "search", "scope-inference", "visual-analysis", None, "planner_waiting_for_llm", None, "catalog-map", None, "feed-extraction", None, "search"]
    for _, word, pattern in E.METRICS:
        assert word in pattern.lower() and word == word.lower()
    E.log_lines(d).explain()
    assert capsys.readouterr().out.count("regexp_replace(") <= 4


def test_a_page_stored_twice_is_one(spark, tmp_path):
    """x1 tells a page's links once, those of all its copies."""
    from tessera import queries as Q

    html = lambda *h: "".join(f'<a href="/{x}">x</a>' for x in h)
    rows = [(1, "https://a.example/p", html("thin", "path")), (2, "https://a.example/p", html("moth", "thin")), (3, "https://a.example/q", html("none"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in Q.QUERIES["x1_stream_links"](spark, str(tmp_path)).collect()]
    assert got == [("https://a.example/p", [f"https://a.example/{x}" for x in ("moth", "path", "thin")])]
