from pyspark.sql import functions as F

from tessera.operators import decisions as D
from tessera.operators import geo as G
from tessera.operators import graph
from tessera.operators import reports as R
from tessera.operators import windows as W


def log(spark, *rows):
    return spark.createDataFrame([(i, n, s) for i, text in rows for n, s in enumerate(text.split())], "id string, ts int, status string")


def test_streaks(spark):
    d = log(spark, ("a", "dead dead unknown dead dead live dead"), ("b", "unknown"))
    plain = [r["streak"] for r in W.failure_streaks(d).where("id = 'a'").orderBy("ts").collect()]
    reset = [r["streak"] for r in W.failure_streaks(d, unknown_resets=True).where("id = 'a'").orderBy("ts").collect()]
    assert plain == [1, 2, 2, 3, 4, 0, 1] and reset == [1, 2, 0, 1, 2, 0, 1]
    assert [(r["id"], r["ts"]) for r in W.review_queue(W.failure_streaks(d)).collect()] == [("a", 4)]
    assert [(r["ts"], r["old_status"]) for r in W.status_changes(d).where("id = 'a'").orderBy("ts").collect()] == [(2, "dead"), (3, "unknown"), (5, "dead"), (6, "live")]


def test_order_operators(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n")], "seq int, k string, v string")
    assert sorted((r["k"] or "", r["v"]) for r in W.first_wins(d, ["k"]).collect()) == [("", "n"), ("a", "x"), ("b", "y")]
    assert sorted((r["k"] or "", r["seq"], r["v"]) for r in W.last_wins(d, ["k"]).collect()) == [("", 4, "n"), ("a", 1, "z"), ("b", 2, "y")]
    assert [tuple(r) for r in W.top_counts(d, "k", "seq", 2).collect()] == [("a", 2), ("b", 1)]
    batches, rest = W.numbered_batches(d, ["seq"], 2, 1)
    assert [r["batch"] for r in batches.collect()] == [1, 1] and rest.count() == 2
    assert [r["last_values"] for r in W.keep_last(d.where("k = 'a'"), ["k"], "seq", "v", 1).collect()] == [["z"]]
    filled = W.forward_filled(d.withColumn("g", F.lit(1)), ["g"], "seq", "k", "f").orderBy("seq").collect()
    assert [r["f"] for r in filled] == ["a", "b", "a", "a"]
    assert tuple(W.latest_metrics(d.withColumn("r", F.lit("r")), "r", "seq", ["k"], ["seq"]).first()) == ("r", "a", 10)
    assert W.first_wins(d.limit(0), ["k"]).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("http://a/1", "live", None, 1.0, 2.0), ("http://a/2", "unknown", "timeout", None, 2.0), ("http://b/3", "dead", "http_404", 1.0, 2.0)], "url string, status string, fail_reason string, latitude double, longitude double")
    assert tuple(R.status_counts(rows).first()) == (3, 1, 1, 1, 1)
    assert sorted(tuple(r) for r in R.source_performance(rows, rows).collect()) == [("a", 2, 1, 1, 1), ("b", 1, 0, 1, 0)]
    assert tuple(R.export_summary(rows, rows.limit(2)).first()) == (3, 1, 2, 1, 1)
    before = spark.createDataFrame([("1", "live"), ("2", "dead")], "id string, status string")
    checks = spark.createDataFrame([("1", "dead", "d"), ("2", "dead", "d"), ("3", "dead", "d")], "id string, status string, checked_at string")
    assert R.health_summary(before, checks).first().asDict() == {"total": 3, "live": 0, "dead": 3, "unknown": 0, "newly_dead": 2}
    assert sorted(r["id"] for r in R.newly_dead(before, checks).collect()) == ["1", "3"]
    kept = R.with_health(before.withColumn("last_verified", F.lit("x")), checks.limit(1)).orderBy("id").collect()
    assert [(r["status"], r["last_verified"]) for r in kept] == [("dead", "d"), ("dead", "x")]
    e = R.error_counts(spark.createDataFrame([("f", "HTTP 403 Forbidden, timed out"), ("f", None)], "a string, t string"), "a", "t").collect()
    assert {r["error"]: r["n"] for r in e}["http_403"] == 2
    caps = spark.createDataFrame([("c", 2.0, "PAGES")], "cap_name string, cap_value double, hint string")
    m = spark.createDataFrame([("pages.a", "3"), ("pages.b", "x"), ("pages.c", "2")], "metric string, value string")
    assert [r["metric"] for r in R.cap_audit(m, caps).collect()] == ["pages.a"]


def test_geo(spark):
    assert [r[0] for r in spark.createDataFrame([("Rome view of x",), ("LIVE cam",), ("A - B",), (None,)], "l string").select(G.place_of_label(F.col("l"))).collect()] == ["Rome", None, "A, B", None]
    g = spark.createDataFrame([("city", "Rome", 1.0, 2.0, "Italy", None, "Europe"), ("host", "h.example", 3.0, 4.0, None, None, None)], "kind string, key string, latitude double, longitude double, country string, region string, continent string")
    r = spark.createDataFrame([("Rome", "x", None, "http://h.example", None, None, None), (None, None, None, "http://www.h.example", '{"latitude":9,"longitude":8}', None, None)], "city string, label string, country string, url string, notes string, latitude double, longitude double")
    got = [(x["geo_source"], x["geo_confidence"], x["coordinate_source"], x["latitude"]) for x in G.with_coordinates(G.looked_up(r, g)).orderBy("geo_source").collect()]
    assert got == [("city", "high", "geocoder", 1.0), ("host", "low", "notes", 9.0)]
    assert [x["id"] for x in G.records(r.withColumn("coordinate_source", F.lit("feed")), "d").collect()][0] == "rome-x"


def test_decisions(spark):
    raw = spark.createDataFrame([(1, 'x ```json\n{"decision":"Approved","confidence":85,"reason":["a","b"]}```'), (2, "nonsense"), (3, '{"decision":"?","confidence":-1,"evidence":"e"}')], "item_id int, raw string")
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "item_id int")
    got = {r["item_id"]: tuple(r)[1:] for r in D.scope_decisions(raw, items).collect()}
    assert got[1] == ("accept", 0.85, "a; b", []) and got[2][:3] == ("reject", 0.0, "scope_decision_parse_error")
    assert got[3] == ("review", 0.0, "", ["e"]) and got[4][2] == "scope_decision_missing"
    rows, errors = D.response_table(spark.createDataFrame([(1, '{"locations":"Rome","place":["Oslo"],"ok":true,"coordinates":[{"lat":1.5}]}'), (2, '{"locations":[]}'), (3, "x")], "item_id int, raw string"), ["locations"], {"locations": "place"}, "ok")
    assert [(r["item_id"], r["locations"], r["coordinates"]) for r in rows.collect()] == [(1, ["Rome", "Oslo"], [{"lat": 1.5}])]
    assert sorted((r["item_id"], r["error"]) for r in errors.collect()) == [(2, "missing_ok"), (3, "not_json")]
    d = spark.createDataFrame([(1, "http://h/a/?utm_x=1"), (2, "http://h/a")], "seq int, url string")
    back = D.fanned_back(d, lambda one: one.select("_key", F.lit("accept").alias("decision")))
    assert [r["decision"] for r in back.collect()] == ["accept", "accept"]
    known = spark.createDataFrame([("h",)], "domain string")
    assert D.new_sources(d, known).count() == 0 and D.new_sources(d, known.limit(0)).first()["hits"] == 2
    s = spark.createDataFrame([("HTTP://h/A ", ["p"], "r", "q"), ("http://z", ["p"], "r", "q")], "url string, parent_pages array<string>, root_url string, source_query string")
    c = spark.createDataFrame([("http://h/a", "L", ["d"])], "url string, label string, source_refs array<string>")
    assert sorted((r["url"], r["source_refs"]) for r in D.original_candidates(s, c).collect()) == [("http://h/a", ["d"]), ("http://z", ["p", "r"])]


def test_plans(spark):
    cities = spark.createDataFrame([("Rome",), ("Oslo",)], "city string")
    langs = spark.createDataFrame([("Rome", "en", 0), ("Rome", "it", 1)], "city string, lang string, pos int")
    terms = spark.createDataFrame([("en", "webcam", 0), ("it", "dal vivo", 0), ("it", "b", 1), ("it", "c", 2)], "lang string, term string, pos int")
    templates = spark.createDataFrame([(1, 0, "{city} {term}"), (2, 0, "{city} m3u8")], "grp int, pos int, template string")
    got = [(r["city"], r["query"]) for r in D.city_queries(cities, langs, terms, templates, most=3).orderBy("city", "n").collect()]
    assert got == [("Oslo", "Oslo live webcam"), ("Oslo", "Oslo m3u8"), ("Rome", "Rome webcam"), ("Rome", "Rome dal vivo"), ("Rome", "Rome b")]
    places = spark.createDataFrame([("location", "PA", 0), ("domain", "d.example", 1)], "kind string, value string, pos int")
    t = spark.createDataFrame([("location", "{} cams", 0, False), ("location", "{} 511", 1, True), ("domain", "site:{}", 0, False)], "kind string, template string, pos int, traffic boolean")
    assert [r["query"] for r in D.expanded_plan(places, t, ["road cams"]).collect()] == ["PA cams", "PA 511", "site:d.example"]
    assert [r["query"] for r in D.expanded_plan(places, t, []).collect()] == ["PA cams", "site:d.example"]
    src = spark.createDataFrame([("u", 2, 1, "HLS"), ("u", 1, 9, "HLS"), ("v", 1, 1, "page"), ("w", 3, 1, "HLS")], "url string, tier int, pos int, feed_type string")
    assert [(r["url"], r["tier"]) for r in D.tier_sources(src, 2).collect()] == [("v", 1), ("u", 1)]
    assert [r["url"] for r in D.tier_sources(src, 2, True).collect()] == ["u"] and D.tier_counts(src).count() == 3


def test_graph(spark):
    links = spark.createDataFrame([("http://h/a", "http://h/b"), ("http://h/b", "http://h/a"), ("http://h/b", "http://h/c"), ("http://h/a", "http://o/x"), ("http://h/c", "http://h/login"), ("http://h/c", "http://h/d")], "page string, link string")
    roots = spark.createDataFrame([("http://h/a",)], "url string")
    got = {(r["url"], r["depth"], r["parent"]) for r in graph.expand(roots, links).collect()}
    assert got == {("http://h/a", 0, None), ("http://h/b", 1, "http://h/a"), ("http://h/c", 2, "http://h/b"), ("http://h/d", 3, "http://h/c")}
    assert {r["url"] for r in graph.expand(roots, links, max_depth=1).collect()} == {"http://h/a", "http://h/b"}
    assert len(graph.expand(roots, links, max_pages=2).collect()) == 2
    up = {r["url"]: r["parent_pages"] for r in graph.lineage(graph.expand(roots, links), 3).collect()}
    assert up["http://h/d"] == ["http://h/a", "http://h/b", "http://h/c"] and up["http://h/a"] == []


def test_health_summary_names_the_newly_dead(spark, tmp_path):
    """a18 tells which ids are newly dead, not only how many."""
    from tessera import queries_observed as Q

    events = [(0, 5, "error"), (1, 6, "error"), (2, 7, "error"), (3, 7, "view"), (4, 8, "other"), (5, 9, "view"), (6, 9, "error")]
    made = spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumns({"ts": F.timestamp_seconds("event_id"), "value": F.lit(0.0)})
    made.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = Q.a18_health_summary(spark, str(tmp_path)).collect()
    assert [tuple(r)[:5] for r in got if r["total"] is not None] == [(5, 1, 3, 1, 2)]
    assert sorted(r["newly_dead_id"] for r in got if r["total"] is None) == ["6", "9"]
