from pyspark.sql import functions as F

from tessera.operators import gates as G


def test_policies(spark):
    body = "User-agent: *\nAllow: /live/ok\nDisallow: /live\n\nUser-agent: bot\nDisallow: /private # x\n"
    r = spark.createDataFrame([("a", 200, body), ("b", 404, "User-agent: *\nDisallow: /"), ("c", 200, "User-agent: *\nDisallow:"), ("d", 200, "User-agent: x\nUser-agent: *\nDisallow: /cam")], "domain string, status_code int, body string")
    got = {x["domain"]: (x["allowed"], x["disallowed"]) for x in G.robots_policies(r, "bot").collect()}
    assert got == {"a": (False, ["/live", "/private"]), "b": (True, []), "c": (True, []), "d": (False, ["/cam"])}
    c = spark.createDataFrame([("http://www.a/x",), ("http://e/x",)], "url string")
    assert [x["url"] for x in G.robots_gate(c, G.robots_policies(r)).collect()] == ["http://e/x"]


def test_blocked(spark):
    c = spark.createDataFrame([("http://a.b.example/",), ("http://xb.example/",), ("http://www.b.example",)], "url string")
    b = spark.createDataFrame([("B.example",)], "domain string")
    assert [x["url"] for x in G.without_blocked(c, b).collect()] == ["http://xb.example/"]


def test_rules(spark):
    c = spark.createDataFrame([(1, "São-Paulo city", "x"), (2, "Rome", "são paulo"), (3, None, None)], "i int, city string, label string")
    r = spark.createDataFrame([("city", "são paulo")], "field string, term string")
    assert sorted(x["i"] for x in G.without_rules(c, r, ["city", "label"]).collect()) == [2, 3]
    r = spark.createDataFrame([(None, "são paulo"), ("city", "")], "field string, term string")
    assert sorted(x["i"] for x in G.without_rules(c, r, ["city", "label"]).collect()) == [3]


def test_scores(spark):
    c = spark.createDataFrame(
        [("https://x.example/rome/live.m3u8", "https://p.example/camera", None, None, 0.9), ("rtsp://x", None, None, None, 0.0), ("https://github.com/a.m3u8", None, None, None, 0.0), ("https://x.example/a", None, None, "rome", 0.0)],
        "candidate_url string, source_page string, root_url string, source_query string, page_relevance_score double",
    )
    got = [(r["priority"], r["priority_score"], r["priority_reason"], r["sent_to_validation"]) for r in G.priorities(c, ["Rome"]).collect()]
    assert got == [("high", 0.89, "prioritized_for_validation", True), ("low", 0.0, "malformed_url", False), ("low", 0.0, "policy_blocked_test_domain", False), ("low", 0.4, "prioritized_for_validation", True)]
    kept = c.withColumn("camera_likelihood_score", F.lit(0.0))
    assert [r["reason"] for r in G.relevance(kept, ["rome"]).collect()] == ["accepted: source lineage + target evidence", "rejected: no source-page target evidence", "rejected: generic demo/test domain", "rejected: query-only target evidence"]
    p = spark.createDataFrame([("http://x/cctv map camera live stream", "rome"), ("privacy terms", None)], "url string, title string")
    got = [(r["page_type"], r["requires_deep_dive"], r["max_depth"]) for r in G.triage(p, ["rome"], ["url", "title"]).collect()]
    assert got == [("camera_listing_or_map", True, 3), ("generic_search_result", False, 0)]


def test_verdicts(spark):
    d = spark.createDataFrame([(200, "text/html", "#EXTM3U\n#EXT-X-STREAM-INF:"), (206, "application/x-mpegURL", "x"), (200, None, None), (404, None, None), (None, None, None)], "c int, t string, b string")
    got = [tuple(r[0]) for r in d.select(G.probe_verdict(F.col("c"), F.col("t"), F.col("b"))).collect()]
    assert got == [("live", "high", None, "master"), ("live", "medium", None, None), ("unknown", "low", "no_magic", None), ("dead", "low", "http_404", None), ("unknown", "low", "timeout", None)]
    codes = spark.createDataFrame([(207,), (206,), (302,), (407,), (None,)], "c int")
    assert [r[0]["status"] for r in codes.select(G.http_status(F.col("c"), F.lit(True))).collect()] == ["dead", "live", "unknown", "dead", "unknown"]
    f = spark.createDataFrame([("master", "x", None), (None, "http://a/b.m3u8", None), (None, "x", "audio/mpegurl"), (None, None, None)], "p string, u string, t string")
    assert [r[0] for r in f.select(G.feed_type(F.col("p"), F.col("u"), F.col("t"))).collect()] == ["HLS_master", "HLS_stream", "HLS_stream", "unknown"]


def test_small_rules(spark):
    d = spark.createDataFrame([("high", "live"), ("low", "live"), ("high", "unknown"), (None, "live")], "s string, st string")
    assert [r[0] for r in d.select(G.legitimacy_ok(F.col("s"), F.col("st"), "medium")).collect()] == [True, False, False, False]
    assert [r[0] for r in d.select(G.legitimacy_ok(F.col("s"), F.col("st"), "low")).collect()] == [True, True, True, False]
    b = spark.createDataFrame([("1", "2"), ("x", "2"), (None, "2"), ("5", "9")], "x string, y string")
    assert [r[0] for r in b.select(G.in_bbox(F.col("x"), F.col("y"), (0, 0, 5, 5))).collect()] == [True, False, False, False]
    assert b.select(G.in_bbox(F.col("x"), F.col("y"), None)).first()[0] is None
    t = spark.createDataFrame([("Sorry, Camera OFFLINE",), ("fine",), (None,)], "t string")
    assert [r[0] for r in t.select(G.offline_flag(F.col("t"))).collect()] == [True, False, False]
    assert spark.createDataFrame([("the dot, dotted",)], "t string").select(G.word_hits(F.col("t"), ["dot", "otte", "the dot"])).first()[0] == ["dot", "the dot"]
    q = spark.createDataFrame([("p", "r", 0.5, "a", "b", "c"), ("p", "", None, "a", None, "c")], "stage string, reason string, confidence double, provider string, model string, raw string")
    assert tuple(G.decision_gaps(q).first()) == ("p", 2, 1, 1)
