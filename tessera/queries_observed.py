"""Queries over what is observed of candidates: probes, policies, feeds, playlists, frames, logs, decisions, sources.

The tables hold no probes, playlists or feeds; Spark derives them from rows of the tables (an event is a probe or
a log line, an order a playlist, a supplier a feed record, a customer a candidate), all rows, in every case that
an operator tells apart. The SQL derives the same and states the rules in its own way.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import decisions, extract, gates, geo, reports, status, windows
from tessera.plans import build
from tessera.queries import LOCATED, LOG, candidates, entities, health_log, located, query, table
from tessera.sources import files
from tessera.storage import shared_dir
from tessera.streaming import jobs


def no_text() -> Column:
    return F.lit(None).cast("string")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def text(*parts) -> Column:
    """A text of literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def picked(n: Column, *values) -> Column:
    """One of several literals, by a number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


# --- URLs ---------------------------------------------------------------------------------------------------------

#: URLs of every bucket and class, one kind for each remainder of a customer's number.
KINDS = (
    "https://h{}.example/a.m3u8?x=1", "rtsp://h{}.example/live", "https://h{}.example/v.mpd", "https://www.youtube.com/embed/{}", "http://h{}.example/mjpeg?c=1",
    "https://h{}.example/v.mp4", "http://h{}.example/snapshot/1", "https://h{}.example/embed/x", "ftp://h{}.example/p.html", "https://h{}.example/about-us",
    "https://h{}.example/webcams/rome", "https://h{}.example/webcams/rome/cam/1", "https://h{}.example/player?u=https%3A%2F%2Fcdn.example%2F{}.m3u8", "http://h{}.example/login/a.m3u8",
)
_KINDS = ", ".join(f"'{k}'" for k in KINDS)
MADE = f"made as (select c_custkey as k, replace([{_KINDS}][c_custkey % {len(KINDS)} + 1], '{{}}', cast(c_custkey as varchar)) as url from customer)"


def made_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), F.replace(picked(k, *KINDS), F.lit("{}"), k.cast("string")).alias("url"))


@query(
    f"""with {MADE} select k, url, case k % {len(KINDS)} when 12 then 'https://cdn.example/' || k || '.m3u8' else url end as clean,
  case when k % {len(KINDS)} in (1, 8) then 'missing_protocol' when k % {len(KINDS)} = 13 then 'auth_url_pattern' when k % {len(KINDS)} not in (0, 12) then 'not_hls' end as reason,
  regexp_matches(url, '(?i)\\.m3u8(\\?|$)') and starts_with(url, 'http') as direct, contains(url, '.m3u8') as loose, regexp_matches(url, '\\.m3u8([?/]|$)') as browser from made"""
)
def p4_unwrapped(spark, sf):
    """Unwrapping, the reject waterfall and all three stream predicates over URLs of every kind."""
    u = F.col("url")
    return made_urls(spark, sf).select(
        "k", "url", U.unwrapped(u).alias("clean"), U.reject_reason(u).alias("reason"), U.is_stream(u).alias("direct"), U.is_stream(u, "loose").alias("loose"), U.is_stream(u, "browser").alias("browser")
    )


@query(
    f"""with {MADE} select k, ['.m3u8', 'RTSP', 'DASH', 'YouTube-only source', 'MJPEG', 'MP4-only', 'JPEG-refresh', 'Other/HTML/unknown', 'Other/HTML/unknown', 'Other/HTML/unknown',
  'Other/HTML/unknown', 'Other/HTML/unknown', '.m3u8', '.m3u8'][k % {len(KINDS)} + 1] as bucket,
  ['hls-stream', 'invalid-protocol', 'html-page', 'youtube-embed', 'html-page', 'mp4-file', 'html-page', 'embed-page', 'invalid-protocol', 'html-page', 'html-page', 'html-page', 'hls-stream', 'hls-stream'][k % {len(KINDS)} + 1] as url_type,
  k % {len(KINDS)} in (9, 10) as is_listing from made"""
)
def p10_url_classes(spark, sf):
    """Every bucket and every report class, and listings by each of their rules but the path's."""
    u = F.col("url")
    return made_urls(spark, sf).select("k", U.format_bucket(u).alias("bucket"), U.url_type(u).alias("url_type"), U.is_listing_page(u).alias("is_listing"))


@query(
    """select c_custkey as k, ['https://a.example/x/l.m3u8', 'https://b.example/l.m3u8', 'https://a.example/l.m3u8', 'https://a.example/p/q/l.m3u8?t=1', 'https://a.example/q/l.m3u8', 'https://a.example/p/q/http'][c_custkey % 6 + 1] as link from customer"""
)
def p5_normalised_links(spark, sf):
    """Links of six kinds made absolute: relative to the root, with a host, quoted, relative, with dots, plain words."""
    k = F.col("c_custkey")
    raw = picked(k, "\\/x\\/l.m3u8", "//b.example/l.m3u8", "'/l.m3u8'", " l.m3u8?t=1 ", "../q/l.m3u8", "http")
    base = F.when(k % 6 == 4, "https://a.example/p/i.html").otherwise("https://a.example/p/q/i.html")
    return table(spark, sf, "customer").select(k.alias("k"), U.normalised_link(raw, base).alias("link"))


@query(
    """with t as (select c_custkey as k, ['Camera OFFLINE now', 'stream unavailable', 'all fine', 'No signal', 'the image is not available', 'off line'][c_custkey % 6 + 1] as t from customer)
select k, k % 6 not in (2, 5) as off from t"""
)
def p19_offline_flag(spark, sf):
    k = F.col("c_custkey")
    words = picked(k, "Camera OFFLINE now", "stream unavailable", "all fine", "No signal", "the image is not available", "off line")
    return table(spark, sf, "customer").select(k.alias("k"), gates.offline_flag(words).alias("off"))


@query(
    """with d as (select doc_id, case when quality = 1 then 'page' else 'stream' end as stage, case when doc_id % 3 > 0 then 'why' end as reason, case when doc_id % 4 = 0 then null else 0.5 end as confidence,
  case when doc_id % 5 = 0 then '' else 'p' end as provider, 'm' as model, case when doc_id % 7 = 0 then null else '{}' end as raw from labels)
select stage, count(*) as decisions, count(*) filter (reason is null or confidence is null) as without_reason, count(*) filter (provider = '' or raw is null) as without_provenance from d group by 1"""
)
def p22_decision_gaps(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "page").otherwise("stream").alias("stage"), F.when(k % 3 > 0, "why").alias("reason"), F.when(k % 4 > 0, 0.5).alias("confidence"),
        F.when(k % 5 == 0, "").otherwise("p").alias("provider"), F.lit("m").alias("model"), F.when(k % 7 > 0, "{}").alias("raw"),
    )
    return gates.decision_gaps(rows)


# --- pages --------------------------------------------------------------------------------------------------------


def derived_pages(spark: SparkSession, sf: str, html: Column) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf, "pages").select(k.alias("k"), text("https://h", k % 50, ".example/p/", k).alias("url"), html.alias("html"))


PAGES = "derived as (select page_id as k, 'https://h' || page_id % 50 || '.example/p/' || page_id as url, 'https://h' || page_id % 50 || '.example' as origin from pages)"


@query(
    f"""with {PAGES} select 'https://cdn.example/a' || k || '.m3u8' as url, [url] as source_refs, null as notes, 'r' as state_region from derived where k % 4 in (0, 3)
union all select origin || '/live/b' || k || '.m3u8?x=1', [url], 'embedded_in:' || url, null from derived where k % 4 = 0
union all select url, []::varchar[], null, 'r' from derived where k % 4 in (1, 2)"""
)
def x2_expanded_candidates(spark, sf):
    """Pages with two streams, without any, not stored, and with one stream named twice."""
    k = F.col("page_id")
    first = text('<video><source src="https://cdn.example/a', k, '.m3u8"></video>')
    html = F.when(k % 4 == 0, F.concat(first, text('<a href="/live/b', k, '.m3u8?x=1">b</a>'))).when(k % 4 == 3, F.concat(first, first)).otherwise("<p>none</p>")
    pages = derived_pages(spark, sf, html)
    rows = pages.select("url", F.array().cast("array<string>").alias("source_refs"), no_text().alias("notes"), F.lit("r").alias("state_region"))
    return extract.expand_candidates(rows, pages.where(F.col("k") % 4 != 2).select("url", "html")).select("url", "source_refs", "notes", "state_region")


@query(f"with {PAGES} select url as page, 0 as n, origin || '/l?page=' || k as link from derived union all select url, 1, origin || '/x' || k from derived where k % 3 > 0")
def x4_pagination(spark, sf):
    k = F.col("page_id")
    html = text('<a href="/l?page=', k, '">2</a><a href="/about">us</a>', F.when(k % 3 > 0, text('<a href="/x', k, '">Next ›</a>')).otherwise(""), '<a href="/l?page=', k, '">again</a>')
    return extract.pagination_links(derived_pages(spark, sf, html))


@query(
    f"""with {PAGES} select a.url as page, b.url as frame, 'https://cdn.example/' || b.k || '.m3u8' as stream from derived a join derived b on b.k = a.k + 1 where a.k % 2 = 0"""
)
def x5_frame_streams(spark, sf):
    """Even pages show their follower in a frame, after one of a host that is never followed; odd pages have streams."""
    k = F.col("page_id")
    frame = text('<iframe src="https://www.youtube.com/embed/1"></iframe><iframe src="https://h', (k + 1) % 50, ".example/p/", k + 1, '"></iframe>')
    return extract.frame_streams(derived_pages(spark, sf, F.when(k % 2 == 0, frame).otherwise(text('<video src="https://cdn.example/', k, '.m3u8"></video>'))))


@query(
    """with t as (select o_orderkey as seq, unnest(['https://h' || o_orderkey % 40 || '.example/feed.json', 'https://gis.example/A/FeatureServer/' || o_orderkey % 7]) as endpoint from orders)
select endpoint, min(seq) as first_seq from t group by 1 order by 2, 1 limit 30"""
)
def x6_feed_endpoints(spark, sf):
    k = F.col("o_orderkey")
    words = text("see 'https://h", k % 40, ".example/feed.json' or https://gis.example/A/FeatureServer/", k % 7, " and https://n.example/x.html")
    return extract.feed_endpoints(table(spark, sf, "orders").select(k.alias("seq"), words.alias("text")), most=30)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A feed for each nation, of one of three forms, with its suppliers as records; each third has no stream; broken for one nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    stream = F.when(k % 3 == 0, "none").otherwise(text("https://s.example/", k, ".m3u8"))
    inner = text('{"name":"', F.col("s_name"), '","id":"', k, '","media":{"urls":["x","', stream, '"]}', F.when(k % 2 == 0, text(',"lat":"', k % 80, '.5","lon":', k % 170)).otherwise(""), "}")
    record = F.when(n % 3 == 0, text('{"properties":', inner, ',"geometry":{"coordinates":[', k % 170, ",", k % 80, "]}}")).otherwise(inner)
    rows = table(spark, sf, "supplier").groupBy(n.alias("n")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), record.alias("r")))).alias("all"))
    every = F.concat_ws(",", F.transform("all", lambda x: x["r"]))
    body = F.when(F.col("n") == 5, text('{"features":[', every)).when(F.col("n") % 3 == 0, text('{"features":[', every, "]}")).when(F.col("n") % 3 == 1, text('{"data":[],"cameras":[', every, "]}")).otherwise(text("[", every, "]"))
    return rows.select(text("https://e", F.col("n"), ".example/f.json").alias("endpoint"), body.alias("body"))


FEEDS = """feeds as (select 'https://e' || s_nationkey || '.example/f.json' as endpoint, s_suppkey as k, s_name as name, s_nationkey as n,
  (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as pos from supplier),
records as (select endpoint, pos, 'https://s.example/' || k || '.m3u8' as stream, name, cast(k as varchar) as record_id,
  case when k % 2 = 0 then k % 80 + 0.5 when n % 3 = 0 then (k % 80)::double end::double as latitude, case when k % 2 = 0 or n % 3 = 0 then k % 170 end::double as longitude from feeds where k % 3 > 0 and n <> 5)"""


@query(f"with {FEEDS} select * from records")
def x7_feed_records(spark, sf):
    return extract.feed_records(payloads(spark, sf), most=None).drop("raw")


@query(
    f"""with {FEEDS} select stream as url, name as label, latitude, longitude, endpoint as feed_endpoint, record_id as source_record_id, 'coordinate_source: feed' as notes, [endpoint, 'https://p.example/'] as source_refs from records"""
)
def x8_feed_candidates(spark, sf):
    return extract.feed_candidates(extract.feed_records(payloads(spark, sf), most=None), "https://p.example/").drop("raw_metadata")


@query(
    """select 'https://s.example/js/a' || p_partkey || '.js' as base, 'stream' as kind, 'https://cdn.example/' || p_partkey || '/x.m3u8?t=1' as endpoint from part
union all select 'https://s.example/js/a' || p_partkey || '.js', 'api', 'https://s.example/api/cams/' || p_partkey from part union all select 'https://s.example/js/a' || p_partkey || '.js', 'api', 'https://s.example/js/GetCameras' from part where p_partkey % 2 = 0"""
)
def x9_script_endpoints(spark, sf):
    k = F.col("p_partkey")
    body = text('fetch("/api/cams/', k, '");fetch("/api/cams/', k, '");var u="https://cdn.example/', k, '/x.m3u8?t=1"', F.when(k % 2 == 0, "; call('GetCameras')").otherwise(""))
    return extract.script_endpoints(table(spark, sf, "part").select(text("https://s.example/js/a", k, ".js").alias("script_url"), body.alias("body")))


@query(
    """select 'https://p.example/a/b/' || o_orderkey || '/m.m3u8' as url, 0 as n, 'https://p.example/a/b/' || o_orderkey || '/low/' || o_orderkey || '.m3u8' as variant from orders
union all select 'https://p.example/a/b/' || o_orderkey || '/m.m3u8', 1, 'https://p.example/hi.m3u8' from orders union all select 'https://p.example/a/b/' || o_orderkey || '/m.m3u8', 2, 'https://o.example/x' from orders where o_orderkey % 2 = 0"""
)
def x10_playlist_variants(spark, sf):
    k, tag = F.col("o_orderkey"), "#EXT-X-STREAM-INF:B=1\n"
    body = text("#EXTM3U\n", tag, "low/", k, ".m3u8\r\n", tag, "\n#comment\n/hi.m3u8\n", tag, "/hi.m3u8\n", F.when(k % 2 == 0, tag + "https://o.example/x\n").otherwise("stray.m3u8"))
    return extract.playlist_variants(table(spark, sf, "orders").select(text("https://p.example/a/b/", k, "/m.m3u8").alias("url"), body.alias("body")))


@query(
    """with t as (select c_custkey as k, lower(c_mktsegment) as s from customer)
select k, [s, 'old', 'town', 'n', cast(k as varchar)] as cleaned_tokens, ['cam', 'live'] as technical_tokens, upper(s[1]) || s[2:] as label_hint,
  [upper(s[1]) || s[2:], upper(s[1]) || s[2:] || ' Old', 'Old', 'Old Town', 'Town'] as phrases from t"""
)
def x11_url_metadata(spark, sf):
    k = F.col("c_custkey")
    url = text("https://x.example/live/", F.lower("c_mktsegment"), "/oldTown/cam?n=", k)
    out = extract.url_metadata(table(spark, sf, "customer").select(k.alias("k"), url.alias("url")))
    return out.select("k", "cleaned_tokens", "technical_tokens", "label_hint", F.transform("location_phrases", lambda p: p["text"]).alias("phrases"))


@query(
    """select distinct unnest(['https://h' || o_orderkey % 40 || '.example/live', 'https://c.example/' || o_orderkey % 25 || '.m3u8']) as url from orders"""
)
def x13_harvested_urls(spark, sf):
    k = F.col("o_orderkey")
    words = text("x https://h", k % 40, ".example/live y http://n.example/", k, " z 'https://c.example/", k % 25, ".m3u8'")
    return extract.harvested_urls(table(spark, sf, "orders").select(words.alias("t")), "t")


# --- logs ---------------------------------------------------------------------------------------------------------

#: Log lines of every kind; {} is the event's number and {d} a domain.
LINES = (
    "SourcesRegistry: loaded tiers {1: 4, 2: 9} ({} total sources)", "SearchAgent custom queries: {}%", "SearchAgent custom queries: 50%|x| {}/9000", "DirectoryTraversalSkill: {} candidates from {d} (3 pages)",
    "collapsed {} rows (1,000 → 7)", "{d}: {} stream(s) found", "Extracting feeds: 10%|x| {}/5,000", "ValidationAgent: {} candidates received", "probe results - live={}, dead=1, unknown=2, timeout=3, other=4",
    "ffprobe results - live={} unknown=5 dead=6", "{} HLS streams to catalog - live=1 unknown=2 dead=3 dropped_dead=4", "{} validated records (5 with coords, 6 without", "CatalogAgent: {} unique records after dedup (dropped 2)",
    "GeoJSONExportSkill: {} features written, 3 skipped", "run-agentic complete - mapped={}, needs_review_location_unknown=8, rejected=9", "read https://{d}/cam/{}.m3u8 and http://o.example/p", "links from {d} (x)", "crawling {d}", "nothing {}",
)
_LINES = ", ".join(f"'{x}'" for x in LINES)
LOGGED = f"logged as (select event_id as seq, event_id % {len(LINES)} as kind, 'd' || event_id % 30 || '.example' as d, replace(replace([{_LINES}][event_id % {len(LINES)} + 1], '{{}}', cast(event_id as varchar)), '{{d}}', 'd' || event_id % 30 || '.example') as text from events)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    made = F.replace(F.replace(picked(k, *LINES), F.lit("{}"), k.cast("string")), F.lit("{d}"), text("d", k % 30, ".example"))
    return table(spark, sf, "events").select(k.alias("seq"), made.alias("text"))


_NAMES = {0: "source_registry_total_sources", 2: "search_queries_done", 4: "collapsed_duplicates", 6: "feed_extract_done", 7: "validation_candidates_received", 8: "probe_live", 9: "ffprobe_live",
          10: "hls_to_catalog", 11: "validated_records", 12: "catalog_unique_after_dedup", 13: "geojson_features_written", 14: "mapped"}
_STAGES = "['source-registry', 'search', 'search', 'directory-crawl', null, 'feed-extraction', 'feed-extraction', 'validation', null, null, null, null, 'catalog-map', 'catalog-map', 'complete', null, null, 'directory-crawl', null]"


@query(
    f"""with {LOGGED} select seq, {_STAGES}[kind + 1] as stage, case when kind in (3, 15, 16, 17) then d else 'unknown' end as domain, """
    + ", ".join(f"case when kind = {i} then seq end as {n}" for i, n in _NAMES.items())
    + f", case kind when 1 then seq when 2 then 50 end as search_progress_percent, case when kind = 4 then 1000 end::bigint as candidates_before_collapse, case when kind = 8 then 4 end::bigint as probe_other, case when kind = 0 then '{{1: 4, 2: 9}}' end as source_registry_tier_counts from logged"
)
def x14_log_lines(spark, sf):
    rows = extract.log_lines(log(spark, sf))
    return rows.select("seq", "stage", "domain", *_NAMES.values(), "search_progress_percent", "candidates_before_collapse", "probe_other", "source_registry_tier_counts")


@query(
    f"""with {LOGGED} select d as domain, sum(case when kind = 3 then seq end)::bigint as candidates, sum(case when kind = 3 then 3 end)::bigint as pages, max(case when kind = 5 then seq end) as streams from logged where kind in (3, 5) group by 1"""
)
def x14_domain_metrics(spark, sf):
    return extract.domain_metrics(log(spark, sf))


@query(f"with {LOGGED}, u as (select d as domain from logged where kind = 15 union all select 'o.example' from logged where kind = 15) select domain, count(*) as n from u group by 1")
def a21_url_domains(spark, sf):
    return extract.url_domains(log(spark, sf))[0]


@query(f"with {LOGGED} select seq, 0 as pos, 'https://' || d || '/cam/' || seq || '.m3u8' as url from logged where kind = 15 order by seq desc limit 25")
def a21_recent_streams(spark, sf):
    return extract.url_domains(log(spark, sf))[1]


@query(f"with {LOGGED} select max(case when kind = 14 then seq end) as mapped, max(case when kind = 7 then seq end) as validation_candidates_received, sum(case when kind = 13 then seq end)::bigint as geojson_features_written from logged")
def e12_log_state(spark, sf):
    """The last known value of counters of the whole log, and a sum."""
    rows = extract.log_lines(log(spark, sf)).withColumn("run", F.lit("r"))
    return windows.latest_metrics(rows, "run", "seq", ["mapped", "validation_candidates_received"], ["geojson_features_written"]).drop("run")


# --- probes, playlists, frames, verdicts --------------------------------------------------------------------------


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a probe of the stream of its user, of every outcome."""
    k = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in (None, 200, 206, 404, 500, 200, 200)]).cast("array<int>"), (k % 7 + 1).cast("int"))
    body = picked(k, "#EXTM3U\n#EXT-X-STREAM-INF:B=1\nlow.m3u8", "  #EXTM3U\n#EXTINF:2\na.ts", "<html>", None, "")
    rows = table(spark, sf, "events").select("event_id", text("c", F.col("user_id")).alias("url"), gates.probe_verdict(code, picked(k, "application/x-mpegURL", "text/html", None), body).alias("v"))
    return rows.select("event_id", "url", "v.*", k.alias("probed_at"))


PROBES = """raw as (select event_id, 'c' || user_id as url, [null, 200, 206, 404, 500, 200, 200][event_id % 7 + 1] as code, event_id % 3 = 0 as typed, event_id % 5 in (0, 1) as magic, event_id % 5 = 0 as master from events),
probes as (select event_id, url, case when code is null then 'unknown' when code >= 400 then 'dead' when magic or typed then 'live' else 'unknown' end as status,
  case when code is null or code >= 400 then 'low' when magic then 'high' when typed then 'medium' else 'low' end as legitimacy_score,
  case when code is null then 'timeout' when code >= 400 then 'http_' || code when magic or typed then null else 'no_magic' end as fail_reason,
  case when code < 400 and magic then case when master then 'master' else 'media' end end as playlist_type from raw)"""


@query(f"with {PROBES} select * from probes")
def c8_probe_verdicts(spark, sf):
    return probes(spark, sf).select("event_id", "url", "status", "legitimacy_score", "fail_reason", "playlist_type")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates: c0, c1 and so on, one for each customer."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text("c", F.col("c_custkey")).alias("url"))


def observations(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    c, k = numbered(spark, sf), F.col("k")
    return {
        "stream_map": c.where(k % 5 == 0).select(F.col("url").alias("page_url"), text("c", k + 1).alias("stream_url")),
        "offline": c.where(k % 11 == 0).select(F.col("url").alias("page_url")),
        "frames": c.where(k % 4 < 3).select("url", picked(k, "unknown", "live", None, None).alias("frame_status"), picked(k, "frozen_frames", "frames_ok", None, None).alias("detail")),
        "playlists": c.where(k % 3 < 2).select("url", picked(k, "vod_playlist", "live_playlist", None).alias("classification")),
    }


CHAIN = f"""{PROBES}, probed as (select c_custkey as k, arg_max({{'s': status, 'l': legitimacy_score, 'f': fail_reason}}, event_id) as o from customer join probes on url = 'c' || c_custkey group by 1),
lives as (select url, min(legitimacy_score) as score from probes where status = 'live' group by 1),
mapped as (select k, o, k % 11 = 0 as off, u.score as up from probed left join lives u on k % 5 = 0 and u.url = 'c' || (k + 1)),
j2 as (select k, case when off then 'dead' when up is not null then 'live' else o.s end as status, case when up is not null and not off then up else o.l end as legitimacy_score,
  case when off then 'browser_offline_marker' when up is null then o.f end as fail_reason, case when up is not null and not off then 'c' || (k + 1) end as stream_url from mapped),
j3 as (select k, case k % 4 when 0 then 'unknown' when 1 then 'live' else status end as status, legitimacy_score, stream_url,
  case when k % 4 = 1 then null when k % 4 = 0 then 'frozen_frames' when status = 'live' then null else fail_reason end as fail_reason from j2),
j4 as (select k, case when status = 'live' and k % 3 = 0 then 'unknown' else status end as status, legitimacy_score, stream_url, case when status = 'live' and k % 3 = 0 then 'playlist:vod_playlist' else fail_reason end as fail_reason from j3)"""


def upgraded(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    seen, p = observations(spark, sf), probes(spark, sf)
    rows = status.with_probe(numbered(spark, sf), p)
    return status.stream_map_upgrade(rows, p, seen["stream_map"], seen["offline"]), seen


@query(f"with {CHAIN} select * from j2")
def j2_stream_map(spark, sf):
    return upgraded(spark, sf)[0].select("k", "status", "legitimacy_score", "fail_reason", "stream_url")


@query(f"with {CHAIN} select k, status, fail_reason from j3")
def j3_frame_override(spark, sf):
    rows, seen = upgraded(spark, sf)
    return status.frame_override(rows, seen["frames"]).select("k", "status", "fail_reason")


@query(f"with {CHAIN} select k, status, fail_reason from j4")
def j4_playlist_override(spark, sf):
    rows, seen = upgraded(spark, sf)
    return status.playlist_override(status.frame_override(rows, seen["frames"]), seen["playlists"]).select("k", "status", "fail_reason")


@query(f"with {CHAIN} select k, status, fail_reason, stream_url from j4 where status <> 'dead'")
def c9_resolved(spark, sf):
    """The whole chain with frame checks, after which every score passes."""
    seen = observations(spark, sf)
    out = status.resolve(numbered(spark, sf), probes(spark, sf), seen["stream_map"], seen["offline"], seen["frames"], seen["playlists"])
    return out.select("k", "status", "fail_reason", "stream_url")


@query(
    f"""with {CHAIN}, noframes as (select k, case when status = 'live' and k % 3 = 0 then 'unknown' else status end as status, legitimacy_score from j2)
select k, status, legitimacy_score from noframes where status = 'live' and legitimacy_score in ('medium', 'high')"""
)
def c9_resolved_by_score(spark, sf):
    """The chain without frames: unknown rows and low scores go."""
    seen = observations(spark, sf)
    out = status.resolve(numbered(spark, sf), probes(spark, sf), seen["stream_map"], seen["offline"], None, seen["playlists"])
    return out.select("k", "status", "legitimacy_score")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of a playlist per customer with orders, or more: each order is one. Even customers' sequences go up, others' segments change or nothing does."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sequence = F.when(c % 4 == 0, text("#EXT-X-MEDIA-SEQUENCE:", o, "\n")).when(c % 4 == 1, "#EXT-X-MEDIA-SEQUENCE: 7\n").otherwise("")
    body = text("#EXTM3U\n", sequence, F.when(c % 4 == 2, text("s", o, ".ts\n")).otherwise("s.ts\n"), F.when(o % 10 == 0, "#EXT-X-ENDLIST\n").otherwise(""))
    return table(spark, sf, "orders").select(text("p", c).alias("url"), o.alias("taken_at"), body.alias("body"))


SNAPSHOTS = """lagged as (select 'p' || o_custkey as url, o_custkey % 4 as kind, o_orderkey as taken_at, o_orderkey % 10 = 0 as ended, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders),
classes as (select url, taken_at, case when ended or before % 10 = 0 then 'vod_playlist' when kind in (0, 2) then 'live_playlist' when kind = 1 then 'static_playlist' else 'unknown_playlist' end as classification,
  kind = 0 as advanced, kind = 2 as changed, case kind when 0 then taken_at - before when 1 then 0 end::bigint as sequence_delta from lagged where before is not null)"""


@query(f"with {SNAPSHOTS} select * from classes")
def e5_playlist_deltas(spark, sf):
    return status.playlist_classes(snapshots(spark, sf))


@query(
    f"""with {SNAPSHOTS}, last as (select url, arg_max(classification, taken_at) as classification from classes group by 1), c as (select o_custkey as k, count(*) as n from orders group by 1)
select k, coalesce(classification, 'none') as classification, case when classification is null then 'live' when classification = 'live_playlist' then 'live' else 'unknown' end as status from c left join last on url = 'p' || k"""
)
def j22_snapshot_classes(spark, sf):
    """The last class of each playlist against all that were snapped, and what it makes of a live row."""
    last = status.latest(status.playlist_classes(snapshots(spark, sf)).select("url", "taken_at", "classification"), "url", "taken_at")
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumns({"url": text("p", F.col("k")), "status": F.lit("live"), "fail_reason": no_text()})
    out = status.playlist_override(rows, last).join(last.select("url", "classification"), "url", "left")
    return out.select("k", F.coalesce("classification", F.lit("none")).alias("classification"), "status")


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Frames by embeddings: of each hundred vectors one stream, dark, frozen, nearly still or moving by its number; some without pixels."""
    v, s = F.col("vec_id"), F.floor(F.col("vec_id") / 20).cast("bigint")
    value = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 3) * 40).cast("int")))
    pixels = F.transform("embedding", lambda x, i: F.when(s % 5 == 0, F.lit(3)).when(s % 5 == 1, (i * 4).cast("int")).when(s % 5 == 2, (i * 3 + v % 2 * 2).cast("int")).otherwise(value(x)).cast("smallint"))
    return table(spark, sf, "embeddings").select(text("v", s).alias("url"), v.alias("frame_no"), F.when(s % 5 == 4, F.array().cast("array<smallint>")).otherwise(pixels).alias("pixels"))


SHOTS = "shots as (select vec_id // 20 as s, count(*) as n from embeddings group by 1)"


@query(
    f"""with {SHOTS} select 'v' || s as url, case when s % 5 = 4 then null when s % 5 = 0 and n >= 2 or s % 5 = 1 and n > 1 then 'unknown' else 'live' end as frame_status,
  case when s % 5 = 4 then null when s % 5 = 0 and n >= 2 then 'blank_or_dark_frames' when s % 5 = 1 and n > 1 then 'frozen_frames' else 'frames_ok' end as detail from shots"""
)
def a14_frame_verdict_kinds(spark, sf):
    """Blank, frozen, moving and missing frames."""
    return status.frame_verdicts(shots(spark, sf)).select("url", "frame_status", "detail")


@query(
    f"""with {SHOTS} select 'v' || s as url, case when s % 5 = 4 or s % 5 = 0 or s % 5 = 1 and s % 2 = 0 then 'unknown' else 'live' end as status,
  case when s % 5 = 4 then 'decode_failed' when s % 5 in (0, 1) and s % 2 = 0 then 'active_prerecorded_loop_short' when s % 5 = 0 then 'decode_failed' when s % 5 = 1 then 'active_live_static_view'
    when s % 5 = 2 then 'active_live_dynamic' else 'active_live_dynamic' end as substatus,
  case when s % 5 = 4 then 0.2 when s % 5 in (0, 1) and s % 2 = 0 then 0.6 when s % 5 = 0 then 0.4 when s % 5 = 1 then 0.65 else 0.7 end::double as confidence from shots"""
)
def a15_visual_verdicts(spark, sf):
    """With segments that change for even streams: loops, dark, still and moving frames, and none."""
    rows = shots(spark, sf)
    growing = rows.select("url", F.substring("url", 2, 20).cast("bigint").alias("s")).select("url", (F.col("s") % 2 == 0).alias("changed"))
    return status.visual_verdicts(rows, growing)


# --- policies and relevance ---------------------------------------------------------------------------------------

ROBOTS = (
    "User-agent: *\nDisallow: /live\n", "User-agent: *\nDisallow:\n", "User-agent: bot\nDisallow: /x\n", "User-agent: *\nAllow: /live\nDisallow: /live # late\n", "User-agent: *\nDisallow: /\n",
    "User-agent: a\nUser-agent: *\nDisallow: /cam # c\n\nUser-agent: bot\nDisallow: /private\n",
)


def robots(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.min("page_id").alias("n"))
    return hosts.select("domain", F.when(F.col("n") % 6 == 4, 404).otherwise(200).alias("status_code"), picked(F.col("n"), *ROBOTS).alias("body"))


_ROBOTS = ", ".join("'" + r.replace("\n", "' || chr(10) || '") + "'" for r in ROBOTS)
_TESTED = ", ".join(f"'{p}'" for p in gates.ROBOTS_PATHS)
POLICIES = f"""hosts as (select regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') as domain, min(page_id) as n from pages group by 1),
lines as (select domain, unnest(string_split([{_ROBOTS}][n % 6 + 1], chr(10))) as line, generate_subscripts(string_split([{_ROBOTS}][n % 6 + 1], chr(10)), 1) as pos from hosts where n % 6 <> 4),
parts as (select domain, pos, lower(trim(split_part(regexp_replace(line, '#.*$', ''), ':', 1))) as key, trim(regexp_replace(regexp_replace(line, '#.*$', ''), '^[^:]*:?', '')) as value from lines),
marked as (select *, case when key = 'user-agent' and coalesce(lag(key) over w, '') <> 'user-agent' then 1 else 0 end as starts from parts where key in ('user-agent', 'allow', 'disallow') window w as (partition by domain order by pos)),
blocks as (select *, sum(starts) over (partition by domain order by pos) as block from marked),
rules as (select r.domain, r.pos, r.key, r.value, lower(a.value) as agent from blocks r join blocks a on a.domain = r.domain and a.block = r.block and a.key = 'user-agent' where r.key <> 'user-agent'),
firsts as (select domain, path, arg_min(case when key = 'disallow' and value <> '' then 1 else 0 end, pos) as denied from rules, (select unnest([{_TESTED}]) as path) where agent = '*' and (value = '' or starts_with(path, value)) group by all),
policies as (select domain, coalesce(max(denied), 0) = 0 as allowed, coalesce((select list_sort(list(distinct value)) from rules r where r.domain = hosts.domain and agent in ('*', 'bot') and key = 'disallow' and value <> ''), []) as disallowed
  from hosts left join firsts using (domain) group by domain)"""


@query(f"with {POLICIES} select * from policies")
def a17_robots_policies(spark, sf):
    return gates.robots_policies(robots(spark, sf), "bot")


@query(f"with {POLICIES} select page_id from pages join policies on domain = regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') where allowed")
def j5_robots_gate(spark, sf):
    return gates.robots_gate(table(spark, sf, "pages"), gates.robots_policies(robots(spark, sf))).select("page_id")


#: A candidate and its page of each rule: (url, page, query, page's score).
LINEAGES = (
    ("https://github.com/a.m3u8", "https://rome.example/", "", 0.0), ("https://x.example/vod/rome-camera.m3u8", "https://p.example/", "", 0.9), ("https://x.example/a.m3u8", "https://p.example/", "rome cams", 0.9),
    ("https://x.example/ohio.m3u8", "https://p.example/", "", 0.9), ("https://x.example/a.m3u8", "https://p.example/", "", 0.9), ("https://x.example/rome", "https://p.example/", "", 0.9),
    ("https://d.cloudfront.net/rome.m3u8", "https://p.example/", "", 0.5), ("https://d.cloudfront.net/rome.m3u8", "https://p.example/", "", 0.6), ("https://x.example/rome.m3u8", None, "", None),
)
REASONS = (
    "rejected: generic demo/test domain", "rejected: blocked pattern ''vod''", "rejected: query-only target evidence", "rejected: off_target_region_or_agency", "rejected: no source-page target evidence",
    "rejected: missing camera/hls evidence", "rejected: untrusted CDN without strong lineage", "accepted: source lineage + target evidence", "accepted: source lineage + target evidence",
)


@query(
    f"""select l_orderkey as k, [{", ".join(f"'{r}'" for r in REASONS)}][l_orderkey % 9 + 1] as reason, l_orderkey % 9 >= 7 as accepted, case when l_orderkey % 9 >= 7 then 0.9 else 0.1 end::double as relevance_score, count(*) as n from lineitem group by all"""
)
def c2_relevance(spark, sf):
    """Each of the seven rules that reject, and acceptance with and without a page."""
    k = F.col("l_orderkey")
    at = lambda i: picked(k, *[x[i] for x in LINEAGES])
    score = F.element_at(F.array(*[F.lit(x[3]).cast("double") for x in LINEAGES]), (k % 9 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(
        k.alias("k"), at(0).alias("candidate_url"), at(1).alias("source_page"), at(2).alias("source_query"), no_text().alias("root_url"), score.alias("page_relevance_score"), F.lit(0.0).alias("camera_likelihood_score")
    )
    return gates.relevance(rows, locations=["rome"]).groupBy("k", "reason", "accepted", "relevance_score").agg(F.count("*").alias("n"))


#: Answers of models, of every shape.
ANSWERS = (
    '{"decision": "Keep", "confidence": 0.5, "reason": "r"}', 'Sure: {"decision": "no", "confidence": "85%", "reasons": ["a", "b"], "evidence": "e"} done', "not json", '{"decision": "perhaps", "confidence": 7}',
    '```json\n{"decision": true, "confidence": -1, "evidence": ["x", "y"]}\n```',
)


@query(
    """select doc_id as item_id, case when doc_id % 6 = 5 then 'review' else ['accept', 'reject', 'reject', 'review', 'accept'][doc_id % 6 + 1] end as decision,
  case when doc_id % 6 = 5 then 0.0 else [0.5, 0.85, 0.0, 0.07, 0.0][doc_id % 6 + 1] end::double as confidence,
  case when doc_id % 6 = 5 then 'scope_decision_missing' else ['r', 'a; b', 'scope_decision_parse_error', '', ''][doc_id % 6 + 1] end as reason,
  case doc_id % 6 when 1 then ['e'] when 4 then ['x', 'y'] else [] end as evidence from labels"""
)
def c4_scope_shapes(spark, sf):
    """Fenced, wrapped, broken and missing answers, lists and single texts, percentages and what isn't between 0 and 1."""
    items = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    k = F.col("item_id")
    raw = items.where(k % 6 < 5).select("item_id", F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (k % 6 + 1).cast("int")).alias("raw"))
    return decisions.scope_decisions(raw, items)


@query(
    """select doc_id as item_id, case doc_id % 4 when 0 then ['a', 'b'] when 1 then ['c', 'd'] end as places, case doc_id % 4 when 0 then 0.4 else 0.0 end::double as confidence, doc_id % 4 = 0 as ok, null as error from labels where doc_id % 4 < 2
union all select doc_id, null, null, null, case when doc_id % 4 = 2 then 'missing_ok' else 'not_json' end from labels where doc_id % 4 >= 2"""
)
def c5_response_table(spark, sf):
    k = F.col("item_id")
    shapes = ('{"ok": true, "places": ["a", "b"], "confidence": "40%"}', '{"ok": false, "places": "c", "old": ["d", "c"]}', '{"places": []}', "none")
    raw = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id")).withColumn("raw", picked(k, *shapes))
    rows, errors = decisions.response_table(raw, ["places"], {"places": "old"}, required="ok")
    return rows.select("item_id", "places", "confidence", "ok").unionByName(errors.select("item_id", "error"), allowMissingColumns=True)


# --- joins and reports --------------------------------------------------------------------------------------------


@query(
    f"""with {LOCATED} select seq, case when seq % 3 = 0 then 'feed' when seq % 3 = 1 then 'notes' when seq % 7 <> 0 then 'geocoder' end as coordinate_source,
  case when seq % 3 = 0 then 1.5 when seq % 3 = 1 then 2.5 when seq % 7 <> 0 then latitude end::double as latitude, case when seq % 3 = 0 then 3.5 when seq % 3 = 1 then 4.5 when seq % 7 <> 0 then longitude end::double as longitude from located"""
)
def j13_coordinates(spark, sf):
    k = F.col("seq")
    rows = located(spark, sf).select("seq", F.struct("latitude", "longitude").alias("geo"))
    notes = F.when(k % 3 == 1, '{"latitude": 2.5, "longitude": 4.5}').when(k % 3 == 2, "no json")
    rows = rows.withColumns({"latitude": F.when(k % 3 == 0, 1.5), "longitude": F.when(k % 3 == 0, 3.5), "notes": notes})
    return geo.with_coordinates(rows).select("seq", "coordinate_source", "latitude", "longitude")


@query(
    """with c as (select c_custkey as k, 'https://H.example/' || c_custkey as url from customer where c_custkey % 2 = 0)
select c_custkey as k, coalesce(c.url, 'https://h.example/' || c_custkey) as url, case when c.k is not null then 'l' || c.k end as label, case when c.k is not null then ['d'] else ['p', 'r'] end as source_refs, c.k is not null as was_discovered
  from customer left join c on c.k = c_custkey"""
)
def j14_original_candidates(spark, sf):
    k = F.col("c_custkey")
    people = table(spark, sf, "customer")
    streams = people.select(text("https://h.example/", k).alias("url"), F.array(F.lit("p"), F.lit("r")).alias("parent_pages"), F.lit("r").alias("root_url"), k.cast("string").alias("source_query"))
    found = people.where(k % 2 == 0).select(text("https://H.example/", k).alias("url"), text("l", k).alias("label"), F.array(F.lit("d")).alias("source_refs"))
    out = decisions.original_candidates(streams, found)
    return out.select(F.col("source_query").cast("bigint").alias("k"), "url", "label", "source_refs", "was_discovered")


@query("with t as (select o_orderkey as seq, o_custkey % 100 as c from orders), f as (select c, min(seq) as first from t group by 1) select seq, first % 3 = 0 as ok from t join f using (c)")
def j15_fanned_back(spark, sf):
    """Spellings of one URL are decided once, by the first, and all its rows get that."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 100
    url = F.when(k % 2 == 0, text("HTTPS://X.example/", c, "?utm_source=", k)).otherwise(text("https://x.example/", c, "/"))
    rows = table(spark, sf, "orders").select(k.alias("seq"), url.alias("url"))
    return decisions.fanned_back(rows, lambda firsts: firsts.select("_key", (F.col("seq") % 3 == 0).alias("ok"))).select("seq", "ok")


@query(
    f"""with {LOG}, last as (select id, arg_max(status, seq) as status, max(seq) as seen from log group by 1)
select c_custkey as k, coalesce(status, 'old') as status, coalesce(cast(seen as varchar), 'never') as last_verified from customer left join last on id = cast(c_custkey as varchar)"""
)
def j16_with_health(spark, sf):
    checks = status.latest(health_log(spark, sf).select("id", "seq", "status"), "id", "seq").select("id", "status", F.col("seq").cast("string").alias("checked_at"))
    records = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("old").alias("status"), F.lit("never").alias("last_verified"))
    return reports.with_health(records, checks).select(F.col("id").cast("bigint").alias("k"), "status", "last_verified")


@query(
    f"""with {LOG}, checks as (select id, arg_max(status, seq) as status from log group by 1)
select count(*) as total, count(*) filter (status = 'live') as live, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'unknown') as unknown,
  count(*) filter (status = 'dead' and not cast(id as bigint) % 5 = 0) as newly_dead, null as newly_dead_id from checks
union all select null, null, null, null, null, id from checks where status = 'dead' and not cast(id as bigint) % 5 = 0"""
)
def a18_health_summary(spark, sf):
    """The totals, then each id that is newly dead, a row each, so that no row holds all of them. Every fifth was dead before."""
    checks = status.latest(health_log(spark, sf).select("id", "seq", "status"), "id", "seq")
    k = F.col("c_custkey")
    before = table(spark, sf, "customer").select(k.cast("string").alias("id"), F.when(k % 5 == 0, "dead").otherwise("live").alias("status"))
    named = reports.newly_dead(before, checks).select(F.col("id").alias("newly_dead_id"))
    return reports.health_summary(before, checks).unionByName(named, allowMissingColumns=True)


@query(
    f"""with {LOG}, checks as (select id, arg_max(status, seq) as status from log group by 1),
runs as (select *, lag(status) over (partition by id order by ts, seq) as old_status, sum(case when status = 'live' then 1 else 0 end) over (partition by id order by ts, seq rows unbounded preceding) as run from log),
streaks as (select *, sum(case when status = 'dead' then 1 else 0 end) over (partition by id, run order by ts, seq rows unbounded preceding) as streak from runs)
select 'records' as part, cast(c_custkey as varchar) as id, null::bigint as seq, coalesce(k.status, case when c_custkey % 5 = 0 then 'dead' else 'live' end) as detail from customer left join checks k on k.id = cast(c_custkey as varchar)
union all select 'changes', id, seq, old_status || '>' || status from runs where old_status <> status
union all select 'review', id, seq, streak::varchar from streaks where streak >= 2
union all select 'newly_dead', id, null, 'dead' from checks where status = 'dead' and cast(id as bigint) % 5 > 0
union all select 'summary', null, null, count(*) || ' ' || count(*) filter (status = 'dead') || ' ' || count(*) filter (status = 'dead' and cast(id as bigint) % 5 > 0) from checks"""
)
def plan_maintenance(spark, sf):
    """A whole maintenance run: every table that it gives, as rows of one."""
    log = health_log(spark, sf)
    checks = status.latest(log.select("id", "seq", "status"), "id", "seq").select("id", "status", F.col("seq").cast("string").alias("checked_at"))
    k = F.col("c_custkey")
    records = table(spark, sf, "customer").select(k.cast("string").alias("id"), F.when(k % 5 == 0, "dead").otherwise("live").alias("status"), F.lit("never").alias("last_verified"))
    made = build.maintain(records, checks, log, 2, ("ts", "seq"))
    none = {"id": no_text(), "seq": F.lit(None).cast("bigint"), "detail": F.col("status")}
    told = {
        "records": {"id": F.col("id")}, "changes": {"id": F.col("id"), "seq": F.col("seq"), "detail": F.concat_ws(">", "old_status", "status")},
        "review": {"id": F.col("id"), "seq": F.col("seq"), "detail": F.col("streak").cast("string")}, "newly_dead": {"id": F.col("id"), "detail": F.lit("dead")},
        "summary": {"detail": F.concat_ws(" ", "total", "dead", "newly_dead")},
    }
    parts = [made[part].select(F.lit(part).alias("part"), *[c.alias(name) for name, c in (none | columns).items()]) for part, columns in told.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"with {LOCATED}, u as (select url, min(latitude) as latitude from located group by 1) select (select count(*) * 2 from located) as received, (select count(*) * 2 from located) - count(*) as deduplicated, count(*) as \"unique\", count(latitude) as written, count(*) - count(latitude) as skipped from u")
def a19_export_summary(spark, sf):
    rows = located(spark, sf)
    twice = rows.unionByName(rows)
    return reports.export_summary(twice, windows.first_wins(twice, ["url"]))


@query(
    """with s as (select n_name as city, lang, pos from nation, (values ('en', 1), ('fr', 0), ('xx', 2)) l(lang, pos) where n_nationkey % 2 = 0),
t as (select * from (values ('en', 'webcam', 0), ('en', 'live cam', 1), ('en', 'traffic', 2), ('fr', 'caméra', 0), ('fr', 'direct', 1), ('fr', 'route', 2)) t(lang, term, tp)),
j as (select n_name as city, coalesce(t.term, 'live webcam') as term, coalesce(s.pos, 0) as pos, coalesce(t.tp, 0) as tp from nation left join (s join t on s.lang = t.lang and (t.lang = 'en' or t.tp < 2)) on s.city = n_name),
m as (select city, replace(replace(template, '{city}', city), '{term}', term) as query, min((grp, gp, pos, tp)) as o from j, (values ('a', 0, '{city} {term}'), ('b', 0, '{term} in {city}'), ('b', 1, '{city} cams')) g(grp, gp, template) group by all)
select city, (row_number() over (partition by city order by o) - 1)::int as n, query from m qualify row_number() over (partition by city order by o) <= 7"""
)
def j18_city_queries(spark, sf):
    """Queries of every nation as a city: half of them speak English, French and a language without terms."""
    cities = table(spark, sf, "nation").select(F.col("n_name").alias("city"), "n_nationkey")
    languages = cities.where("n_nationkey % 2 = 0").select("city", F.inline(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(p).alias("pos")) for x, p in (("en", 1), ("fr", 0), ("xx", 2))])))
    terms = [("en", "webcam", 0), ("en", "live cam", 1), ("en", "traffic", 2), ("fr", "caméra", 0), ("fr", "direct", 1), ("fr", "route", 2)]
    templates = [("a", 0, "{city} {term}"), ("b", 0, "{term} in {city}"), ("b", 1, "{city} cams")]
    made = decisions.city_queries(cities.select("city"), languages, spark.createDataFrame(terms, "lang string, term string, pos int"), spark.createDataFrame(templates, "grp string, pos int, template string"), most=7)
    return made


@query(
    """with p as (select 'city' as kind, n_name as value, n_nationkey as pos from nation union all select 'agency', r_name, 100 + r_regionkey from region),
t as (select * from (values ('city', '{} cams', 0, false), ('city', '{} traffic', 1, true), ('agency', '{} 511', 0, true), ('agency', '{} cams', 1, false)) t(kind, template, tp, traffic))
select replace(template, '{}', value) as query from p join t using (kind) group by 1 order by min((pos, tp)), 1 limit 25"""
)
def j19_expanded_plan(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.select(F.lit("city").alias("kind"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("pos")).unionByName(
        r.select(F.lit("agency").alias("kind"), F.col("r_name").alias("value"), (F.col("r_regionkey") + 100).alias("pos"))
    )
    templates = spark.createDataFrame([("city", "{} cams", 0, False), ("city", "{} traffic", 1, True), ("agency", "{} 511", 0, True), ("agency", "{} cams", 1, False)], "kind string, template string, pos int, traffic boolean")
    return decisions.expanded_plan(places, templates, ["Road cameras"])


SOURCES = "sources as (select 'https://h' || s_suppkey % 60 || '.example/' as url, s_suppkey % 4 + 1 as tier, s_suppkey as pos, ['HLS_master', 'm3u8', 'mjpeg'][s_suppkey % 3 + 1] as feed_type from supplier)"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(text("https://h", k % 60, ".example/").alias("url"), (k % 4 + 1).alias("tier"), k.alias("pos"), picked(k, "HLS_master", "m3u8", "mjpeg").alias("feed_type"))


@query(f"with {SOURCES} select url, min((tier, pos))[1] as tier, min((tier, pos))[2] as pos from sources where tier <= 2 and feed_type <> 'mjpeg' group by 1")
def g2_tier_sources(spark, sf):
    return decisions.tier_sources(sources(spark, sf), 2, streams_only=True)


@query(f"with {SOURCES} select tier, count(*) as n from sources group by 1")
def a7_tier_counts(spark, sf):
    return decisions.tier_counts(sources(spark, sf))


@query(
    """with l as (select page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as origin, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[''"]([^''"]*)[''"]', 1)) as h from pages),
d as (select distinct url as page, origin || h as link from l where starts_with(h, '/') and not starts_with(h, '//')) select page, count(*) as links, count(p.url) as stored from d left join pages p on p.url = link group by 1"""
)
def j23_links_of_pages(spark, sf):
    """Links joined with the pages that are stored: how many of a page's links lead to one."""
    pages = table(spark, sf, "pages")
    links = extract.same_domain_links(pages).select("page", "link")
    hit = links.join(pages.select(F.col("url").alias("link"), F.lit(1).alias("one")), "link", "left")
    return hit.groupBy("page").agg(F.count("*").alias("links"), F.count("one").alias("stored"))


@query(
    """with l as (select url, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as origin, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[''"]([^''"]*)[''"]', 1)) as h from pages)
select distinct url as page, origin || h as link from l where starts_with(h, '/') and contains(lower(h), 'the')"""
)
def p18_city_links(spark, sf):
    """Links that name a city in their address or their words."""
    return extract.same_domain_links(table(spark, sf, "pages"), city="The").select("page", "link")


@query(f"with {LOG} select id, seq, last_value(v ignore nulls) over (partition by id order by seq) as filled from (select *, case when status = 'dead' then null else seq end as v from log)")
def e8_forward_filled(spark, sf):
    rows = health_log(spark, sf).withColumn("v", F.when(F.col("status") != "dead", F.col("seq")))
    return windows.forward_filled(rows, ["id"], "seq", "v", "filled").select("id", "seq", "filled")


@query(
    f"""with {MADE}, d as (select k as seq, url from made where k % 3 <> 0), s as (select k as seq, url from made where k % 2 = 0 or k % 3 = 0), m as (select * from d union all select * from s)
select contains(url, '.m3u8') as is_stream, url, min(seq) as seq from m group by all"""
)
def u_split_candidates(spark, sf):
    """Candidates of two producers, united and parted into streams and the rest, the first of a URL each."""
    rows = made_urls(spark, sf).withColumnRenamed("k", "seq")
    streams, rest = files.split_candidates(rows.where("seq % 3 <> 0"), rows.where("seq % 2 = 0 or seq % 3 = 0").withColumn("from", F.lit("search")))
    return streams.withColumn("is_stream", F.lit(True)).unionByName(rest.withColumn("is_stream", F.lit(False))).select("is_stream", "url", "seq")


@query(f"with {LOCATED} select seq, country, city, label from located")
def t1_catalogue_order(spark, sf):
    """Sorted by country, region, city and label; a test looks at the order."""
    return windows.catalogue_order(located(spark, sf).withColumn("region", no_text())).select("seq", "country", "city", "label")


@query(
    """with c as (select page_id as seq, row_number() over (partition by regexp_extract(url, '//([^/?#]*)', 1) order by page_id) as n from pages)
select 'candidates' as stage, seq from c order by seq limit 500""".replace("select 'candidates' as stage, seq from c order by seq limit 500",
    "(select 'candidates' as stage, seq from c order by seq limit 500) union all (select 'streams', seq from c order by seq limit 250) union all select 'per source', seq from c where n <= 3")
)
def t3_stage_caps(spark, sf):
    """Caps of a run in catalogue mode: candidates, streams, and streams of each source."""
    caps = build.stage_caps(True, streams=40, per_source_streams=3)
    rows = candidates(spark, sf).withColumn("host", U.authority(F.col("url")))
    parts = [build.capped(rows, caps, "candidates"), build.capped(rows, caps, "streams"), build.capped(rows, caps, "per_source_streams", per="host")]
    one, two, three = (p.select(F.lit(n).alias("stage"), "seq") for n, p in zip(("candidates", "streams", "per source"), parts, strict=True))
    return one.unionByName(two).unionByName(three)


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("select event_id, event_type, value from events")
def s1_jsonl(spark, sf):
    """Written as JSON lines, appended in two parts, and read with a schema."""
    path = scratch(spark, "jsonl")
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    for part in (0, 1):
        files.append_jsonl(rows.where(F.col("event_id") % 2 == part), path)
    files.append_jsonl(rows.limit(0), path)
    return files.read_jsonl(spark, path, rows.schema)


@query("select event_id % 10 = 0 as broken, count(*) as n from events where event_id % 10 <> 5 group by 1")
def s2_tolerant_jsonl(spark, sf):
    """A tenth of the lines is no object, a tenth is blank."""
    path, k = scratch(spark, "lines"), F.col("event_id")
    line = F.when(k % 10 == 0, text("[", k, "]")).when(k % 10 == 5, "  ").otherwise(text('{"id": ', k, "}"))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return files.read_jsonl_tolerant(spark, path).groupBy(F.col("doc").isNull().alias("broken")).agg(F.count("*").alias("n"))


@query("select page_id % 2 as part, url, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') as domain from pages")
def s3_artifacts(spark, sf):
    """Two artifacts that name their URL differently."""
    path, rows = scratch(spark, "artifacts"), table(spark, sf, "pages")
    for part, name in ((0, "url"), (1, "stream_url")):
        made = rows.where(F.col("page_id") % 2 == part).select(F.to_json(F.struct(F.col("url").alias(name))).alias("value"))
        made.write.text(f"{path}/{part}.jsonl")
    return files.read_artifacts(spark, path, "*.txt").select(F.regexp_extract("artifact", r"/(\d)\.jsonl", 1).cast("bigint").alias("part"), "url", "domain")


@query(f"with {LOCATED} select id, country, status from located")
def s8_snapshot(spark, sf):
    """A snapshot of a date is written once: the second of that date changes nothing."""
    path, rows = scratch(spark, "snapshots"), located(spark, sf).select("id", "country", "status")
    files.write_snapshot(rows, path, "2026-01-01")
    files.write_snapshot(rows.where("status = 'dead'"), path, "2026-01-01")
    return spark.read.parquet(path).select("id", "country", "status")


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders")
def s16_csv(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path)
    return spark.read.option("header", "true").csv(path)


@query("select page_id, url, length(html) as n from pages")
def s14_pages(spark, sf):
    return files.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n"))


# --- streams ------------------------------------------------------------------------------------------------------


def arriving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as files that arrive."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def ended(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """What a streaming job has written when all input is processed."""
    path = scratch(spark, name)
    jobs.run_to_end(rows, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("select event_id, user_id, event_type from events")
def r1_intake(spark, sf):
    """JSON files that arrive in a folder, a few at a time."""
    path, schema = scratch(spark, "arrivals"), "event_id bigint, user_id bigint, event_type string"
    table(spark, sf, "events").select("event_id", "user_id", "event_type").repartition(5).write.json(path)
    return ended(spark, jobs.read_stream(spark, path, schema, files_per_batch=2), "intake")


@query("select user_id % 20 as u, user_id % 3 = 0 as is_stream from events group by all")
def r2_new_urls(spark, sf):
    """Users' URLs come once each, however often they arrive; r3 forks them."""
    u = F.col("user_id")
    url = F.when(u % 3 == 0, text("https://p.example/?v=https%3A%2F%2Fs.example%2F", u % 20, ".m3u8")).otherwise(text("https://p.example/", u % 20, "-", u % 3 == 0))
    out = ended(spark, jobs.new_urls(arriving(spark, sf, "events").select(url.alias("url"))), "new-urls")
    return out.select(F.regexp_extract("url", r"example/(\d+)", 1).cast("bigint").alias("u"), U.is_stream(F.col("url")).alias("is_stream"))


@query("select case when event_id % 3 = 0 then 'stream' else 'page' end as side, count(*) as n from events group by 1")
def r3_fork(spark, sf):
    path, k = scratch(spark, "fork"), F.col("event_id")
    rows = arriving(spark, sf, "events").select(F.when(k % 3 == 0, text("https://s.example/", k, ".m3u8")).otherwise(text("https://s.example/", k)).alias("url"))
    jobs.fork(rows, f"{path}/streams", f"{path}/pages", f"{path}/checkpoint").awaitTermination()
    parts = [spark.read.parquet(f"{path}/{d}").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for d, s in (("streams", "stream"), ("pages", "page"))]
    return parts[0].unionByName(parts[1])


@query("select event_id, c_mktsegment from events left join customer on c_custkey = user_id")
def r4_enriched(spark, sf):
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return ended(spark, jobs.enriched(arriving(spark, sf, "events"), dim, "user_id").select("event_id", "c_mktsegment"), "enriched")


#: Seconds that a row may be late where streams are shuffled; the delay of their watermark is longer.
LATE, DELAY = 3600, "2 hours"


def ended_late(spark: SparkSession, sf: str, name: str, time: Column, job, late: int = LATE, parts: int = 3) -> DataFrame:
    """What a streaming job has written of a table that arrives in parts, the job started anew for each: rows come up to `late` seconds late and out of order."""
    path, rows = scratch(spark, f"late-{name}"), table(spark, sf, name)
    arrival = F.unix_seconds(time) + F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(late))
    first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
    rows.limit(0).write.parquet(f"{path}/in")
    made = job(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    for i in range(parts):
        low, high = (first + (last + 1 - first) * k // parts for k in (i, i + 1)) if first is not None else (0, 0)
        rows.where((arrival >= low) & (arrival < high)).write.mode("append").parquet(f"{path}/in")
        jobs.run_to_end(made, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@query(
    f"""with {LOG}, runs as (select *, sum(case when status = 'live' then 1 else 0 end) over (partition by id order by ts, seq rows unbounded preceding) as run, row_number() over (partition by id order by ts, seq) as checks,
  lag(status) over (partition by id order by ts, seq) as old_status from log)
select id, checks, sum(case when status = 'dead' then 1 else 0 end) over (partition by id, run order by ts, seq rows unbounded preceding)::bigint as streak, status, coalesce(old_status <> status, false) as changed, old_status
from runs where ts <= (select max(ts) - interval 2 hour from log)"""
)
def r5_health_states(spark, sf):
    """State by state what e3 and e6 find in windows, up to the watermark; checks arrive out of order and in several batches."""
    s = F.when(F.col("event_type") == "error", "dead").when(F.col("event_type").isin("view", "click"), "live").otherwise("unknown")
    columns = [F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), s.alias("status")]
    out = ended_late(spark, sf, "events", F.col("ts").cast("timestamp"), lambda e: jobs.health_states(e.select(*columns), delay=DELAY))
    return out.select("id", "checks", "streak", "status", "changed", "old_status")


@query(
    """with t as (select time_bucket(interval 1 day, ts) as start, case event_id % 3 when 0 then 'validation' when 1 then 'directory-crawl' end as stage, event_id % 7 = 0 as leak from events)
select start, stage, count(*) as lines, count(*) filter (leak) as leaks from t where start + interval 1 day <= (select max(ts) - interval 10 minute from events) group by all"""
)
def r6_windowed_lines(spark, sf):
    """Days that the watermark has passed, by stage."""
    k = F.col("event_id")
    words = text(picked(k, "probing urls", "crawling x", "nothing"), F.when(k % 7 == 0, " in Texas").otherwise(""))
    beats = jobs.windowed_lines(arriving(spark, sf, "events").select(words.alias("text"), F.col("ts").cast("timestamp").alias("logged_at")), every="1 day", leaks="(?i)texas")
    return ended(spark, beats.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "stage", "lines", "leaks"), "beats")


@query(
    """with t as (select event_id, ts, 'run' || (user_id % 50) as run, event_id % 7 = 0 as hit,
  case event_id % 5 when 0 then 'validation' when 1 then 'directory-crawl' when 3 then 'validation' when 4 then 'catalog-map' end as stage,
  case when event_id % 5 = 3 then event_id end as received, case when event_id % 5 = 4 then event_id end as written from events),
c as (select *, count(*) over w as lines, count(*) filter (hit) over w as hits, last_value(stage ignore nulls) over w as latest, last_value(received ignore nulls) over w as last_received,
  sum(written) over w as all_written, count(written) over w as n_written, min(ts) over w as first from t window w as (partition by run order by ts, event_id rows unbounded preceding)),
stops as (select run, min(ts) as stop_at from c where hit and hits >= 5 and ts >= first + interval 1 day group by run),
ends as (select *, time_bucket(interval 1 day, ts) + interval 1 day as beat from c qualify row_number() over (partition by run, time_bucket(interval 1 day, ts) order by ts desc, event_id desc) = 1)
select e.run, beat, latest as stage, lines, hits, last_received as received, (case when n_written > 0 then all_written end)::bigint as written, coalesce(stop_at < beat, false) as stop, case when stop_at < beat then stop_at end as stop_at
from ends e left join stops using (run) where beat <= (select max(ts) - interval 2 hour from events)"""
)
def r6_heartbeat(spark, sf):
    """Of every run and day the latest stage, counters and hits so far, and since when it is to be stopped; lines arrive late and out of order."""
    k = F.col("event_id")
    said = F.element_at(F.array(F.lit("probing urls"), F.lit("crawling x"), F.lit("nothing"), text("ValidationAgent: ", k, " candidates received"), text("GeoJSONExportSkill: ", k, " features written, 0 skipped")), (k % 5 + 1).cast("int"))
    words = text(said, F.when(k % 7 == 0, " in Texas").otherwise(""))
    columns = [text("run", F.col("user_id") % 50).alias("run"), F.col("ts").cast("timestamp").alias("logged_at"), k.alias("seq"), words.alias("text")]
    job = lambda e: jobs.heartbeat(e.select(*columns), 86_400, DELAY, "(?i)texas", stop_hits=5, grace_seconds=86_400)
    beats = ended_late(spark, sf, "events", F.col("ts").cast("timestamp"), job)
    counter = lambda c: F.try_element_at("counters", F.lit(c))
    return beats.select(
        "run", F.col("beat").cast("timestamp_ntz").alias("beat"), "stage", "lines", "hits", counter("validation_candidates_received").alias("received"),
        counter("geojson_features_written").alias("written"), "stop", F.col("stop_at").cast("timestamp_ntz").alias("stop_at"),
    )


@query(f"with {SNAPSHOTS} select url, taken_at, classification, sequence_delta from classes where taken_at <= (select max(o_orderkey) - 600 from orders)")
def r7_playlist_states(spark, sf):
    """State by state what e5 finds in windows, up to the watermark; the order's number stands for the time, and orders arrive late."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sequence = F.when(c % 4 == 0, text("#EXT-X-MEDIA-SEQUENCE:", o, "\n")).when(c % 4 == 1, "#EXT-X-MEDIA-SEQUENCE: 7\n").otherwise("")
    body = text("#EXTM3U\n", sequence, F.when(c % 4 == 2, text("s", o, ".ts\n")).otherwise("s.ts\n"), F.when(o % 10 == 0, "#EXT-X-ENDLIST\n").otherwise(""))
    time = F.timestamp_seconds(o + 1)  # the watermark begins at 0: what bears that time is late
    columns = [text("p", c).alias("url"), time.alias("taken_at"), body.alias("body")]
    out = ended_late(spark, sf, "orders", time, lambda rows: jobs.playlist_states(rows.select(*columns)), late=300)
    return out.select("url", (F.unix_timestamp("taken_at") - 1).alias("taken_at"), "classification", "sequence_delta")


@query()
def r8_finalised(spark, sf):
    """Intake as a stream, then duplicates over all that it wrote; d1 and its test say what that gives."""
    path = scratch(spark, "intake")
    rows = entities(spark, sf)
    rows.write.parquet(f"{path}/in")
    intake = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    running = intake.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    return jobs.finalised(spark, running, f"{path}/out").select("seq", "url", "merged_rows", "source_refs")
