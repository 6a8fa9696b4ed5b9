"""Queries of the catalogue operators over the driver's tables, each with the same result in DuckDB's SQL where it has one.

The tables stand in for ours: pages are pages and candidates, events the health and run log, documents
labels and log texts, customers and nations located records, embeddings frames, labels gate decisions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import decisions, extract, gates, geo, graph, reports, resolve, status, windows
from tessera.sources import files
from tessera.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url")


STATUS = {"error": "dead", "view": "live", "click": "live"}


def health_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    s = F.when(F.col("event_type") == "error", "dead").when(F.col("event_type").isin("view", "click"), "live").otherwise("unknown")
    return e.select(F.col("user_id").cast("string").alias("id"), "ts", F.col("event_id").alias("seq"), s.alias("status"), "value")


LOG = """log as (select cast(user_id as varchar) as id, ts, event_id as seq, value,
  case when event_type = 'error' then 'dead' when event_type in ('view', 'click') then 'live' else 'unknown' end as status from events)"""


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as records: every seventh without coordinates, nation as country, region as continent."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("c_custkey")
    lat = F.when(k % 7 != 0, (k % 170) - 85.0)
    return rows.select(
        k.alias("seq"), F.col("c_name").alias("id"), F.col("c_mktsegment").alias("label"), F.concat(F.lit("city"), k % 40).alias("city"), F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"), lat.alias("latitude"), F.when(k % 7 != 0, (k % 350) - 175.0).alias("longitude"),
        F.concat(F.lit("https://h"), k % 50, F.lit(".example/v"), k, F.lit(".m3u8")).alias("url"),
        F.when(F.col("c_acctbal") < 0, "dead").when(F.col("c_acctbal") > 5000, "live").otherwise("unknown").alias("status"),
        F.when(F.col("c_acctbal") < -500, "timeout").when(F.col("c_acctbal") < 0, "http_404").when(F.col("c_acctbal") < 500, "timeout").alias("fail_reason"),
    )


LOCATED = """located as (select c_custkey as seq, c_name as id, c_mktsegment as label, 'city' || (c_custkey % 40) as city, n_name as country, r_name as continent,
  case when c_custkey % 7 <> 0 then (c_custkey % 170) - 85.0 end as latitude, case when c_custkey % 7 <> 0 then (c_custkey % 350) - 175.0 end as longitude,
  'https://h' || (c_custkey % 50) || '.example/v' || c_custkey || '.m3u8' as url,
  case when c_acctbal < 0 then 'dead' when c_acctbal > 5000 then 'live' else 'unknown' end as status,
  case when c_acctbal < -500 then 'timeout' when c_acctbal < 0 then 'http_404' when c_acctbal < 500 then 'timeout' end as fail_reason
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

PARTS = """parts as (select page_id, url, html, regexp_extract(url, '//([^/?#]*)', 1) as a, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as p,
  regexp_extract(url, '\\?([^#]*)', 1) as q from pages)"""
TRACKING = ", ".join(f"'{t}'" for t in U.TRACKING_PARAMS)
KEYED = f"""{PARTS}, keyed as (select *, lower('https://' || regexp_replace(a, '^www\\.', '') || rtrim(p, '/') ||
  case when len(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({TRACKING}))) = 0 then ''
  else '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({TRACKING}))), '&') end) as k from parts)"""
BUCKET = """case when regexp_matches(lower(url), '\\.m3u8($|\\?)') then '.m3u8' when regexp_matches(lower(url), '\\.mp4($|\\?)') then 'MP4-only'
  when regexp_matches(lower(url), 'snapshot|refresh') then 'JPEG-refresh' else 'Other/HTML/unknown' end"""


@query(
    f"""with {KEYED}, firsts as (select k, min(page_id) as page_id from keyed group by k)
select regexp_replace(a, '^www\\.', '') as domain, {BUCKET} as bucket, count(*) as n from firsts join keyed using (page_id) group by 1, 2"""
)
def domain_formats(spark, sf):
    """The flagship: canonical keys, first of each, format buckets per domain."""
    rows = candidates(spark, sf).withColumn("key", U.catalogue_key(F.col("url")))
    first = windows.first_wins(rows, ["key"])
    return first.groupBy(U.domain(F.col("url")).alias("domain"), U.format_bucket(F.col("url")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {KEYED} select page_id, k as key from keyed")
def p1_catalogue_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.catalogue_key(F.col("url")).alias("key"))


@query(
    f"""with {PARTS} select page_id, lower(regexp_extract(url, '^([^:]+)', 1)) || '://' || lower(a) || case when rtrim(p, '/') = '' then '/' else rtrim(p, '/') end ||
  case when len(list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_'))) = 0 then ''
  else '?' || array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_')), '&') end as key from parts"""
)
def p2_gate_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.gate_key(F.col("url")).alias("key"))


@query(
    f"""with {PARTS} select page_id, a || regexp_replace(p, '^/[a-z]{{2}}(?:[_-][a-zA-Z]{{2,4}})?/', '/') || case when q = '' then '' else '?' || q end as key from parts"""
)
def p3_language_neutral_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.language_neutral_key(F.col("url")).alias("key"))


@query("""select page_id, regexp_matches(url, '(?i)\\.html(\\?|$)') as is_html, regexp_matches(url, '(?i)\\.m3u8(\\?|$)') and regexp_matches(url, '(?i)^https?://') as is_stream from pages""")
def p6_stream_predicate(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(r"(?i)\.html(\?|$)").alias("is_html"), U.is_stream(F.col("url")).alias("is_stream"))


@query(
    f"""with {PARTS} select coalesce(case when not regexp_matches(url, '(?i)^https?://') then 'missing_protocol'
  when regexp_matches(p, '(?i)/(login|signin|sign-in|auth|register|subscribe|account|member|join)') then 'auth_url_pattern'
  when not regexp_matches(url, '(?i)\\.html(\\?|$|#)') then 'not_hls' end, 'ok') as reason, count(*) as n from parts group by 1"""
)
def p7_reject_waterfall(spark, sf):
    reason = F.coalesce(U.reject_reason(F.col("url"), r"(?i)\.html(\?|$|#)"), F.lit("ok"))
    return table(spark, sf, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"select {BUCKET} as bucket, count(*) as n from pages group by 1")
def p8_format_bucket(spark, sf):
    return table(spark, sf, "pages").groupBy(U.format_bucket(F.col("url")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """select page_id, case when regexp_matches(html[1:65536], '(?i)[''"][^''"]{4,500}\\.mp4[^''"]{0,100}[''"]') then 'MP4-only'
  when regexp_matches(html[1:65536], '(?i)snapshot|getimage') then 'JPEG-refresh' else 'Other/HTML/unknown' end as bucket from pages"""
)
def p9_observed_bucket(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.observed_bucket(F.col("url"), F.lit("text/html"), F.col("html")).alias("bucket"))


@query("select case when regexp_matches(url, '(?i)/embed[/?]|embed\\.') then 'embed-page' when not regexp_matches(url, '(?i)^https?://') then 'invalid-protocol' else 'html-page' end as url_type, count(*) as n from pages group by 1")
def p10_url_type(spark, sf):
    return table(spark, sf, "pages").groupBy(U.url_type(F.col("url")).alias("url_type")).agg(F.count("*").alias("n"))


@query(f"with {PARTS} select page_id, regexp_matches(p, '(?i)/(?:tag|tags|category|categories|search|sitemap|feed|rss)(?:/|$|\\?|\\.)') as is_listing from parts")
def p11_listing_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_listing_page(F.col("url")).alias("is_listing"))


@query(
    """select doc_id from (select doc_id, case when quality = 1 then 'high' when doc_id % 2 = 0 then 'medium' else 'low' end as score,
  case when toxic = 1 then 'unknown' else 'live' end as status from labels) where case when status = 'unknown' then false else score in ('medium', 'high') end"""
)
def p12_legitimacy_threshold(spark, sf):
    score = F.when(F.col("quality") == 1, "high").when(F.col("doc_id") % 2 == 0, "medium").otherwise("low")
    rows = table(spark, sf, "labels").select("doc_id", score.alias("score"), F.when(F.col("toxic") == 1, "unknown").otherwise("live").alias("status"))
    return rows.where(gates.legitimacy_ok(F.col("score"), F.col("status"), "medium")).select("doc_id")


@query(f"with {LOCATED} select seq, coalesce(longitude between -20 and 60 and latitude between -10.5 and 70, false) as inside from located")
def p13_bbox(spark, sf):
    return located(spark, sf).select("seq", gates.in_bbox(F.col("longitude"), F.col("latitude"), (-20, -10.5, 60, 70)).alias("inside"))


@query(f"with {LOCATED} select 'mapped' as side, count(*) as n from located where latitude is not null and longitude is not null union all select 'review', count(*) from located where latitude is null or longitude is null")
def p14_location_split(spark, sf):
    mapped, review = gates.split_by_location(located(spark, sf))
    return mapped.agg(F.count("*").alias("n")).withColumn("side", F.lit("mapped")).unionByName(review.agg(F.count("*").alias("n")).withColumn("side", F.lit("review")))


@query(f"with {LOCATED} select id, label, country from located where status in ('live', 'unknown') and continent in ('ASIA', 'EUROPE') and contains(lower(concat_ws(' ', city, label, country, continent)), 'mach') order by id limit 100")
def p15_facets(spark, sf):
    return gates.facets(located(spark, sf), "mach", status=("live", "unknown"), continent=("ASIA", "EUROPE")).select("id", "label", "country")


@query(
    f"""with {LOCATED} select seq, trim(regexp_replace(lower(city || ' ' || label), '[^a-z0-9]+', '-', 'g'), '-') as id, label, city, country,
  concat_ws('; ', case when latitude is null then 'location_unknown' end, case when latitude is not null then 'coordinate_source=feed' end) as notes, '2026-01-01' as last_verified from located"""
)
def p16_records(spark, sf):
    rows = located(spark, sf).withColumns({"notes": F.lit(None).cast("string"), "coordinate_source": F.when(F.col("latitude").isNotNull(), "feed")})
    return geo.records(rows, "2026-01-01").select("seq", "id", "label", "city", "country", "notes", "last_verified")


@query("select doc_id from documents where regexp_matches(lower(text), 'the ere|erin ')")
def p19_phrase_flag(spark, sf):
    """The phrase test of the offline markers, with phrases that the documents have."""
    return table(spark, sf, "documents").where(F.lower("text").rlike(gates._any_of(["the ere", "erin "]))).select("doc_id")


@query("""select doc_id from (select doc_id, case when quality = 0 then 'rejected: No source-page target evidence' else 'ok' end as reason, case when toxic = 1 then 'validation' else 'page' end as stage from labels)
  where contains(lower(reason), 'no source-page target evidence') and stage not in ('validation', 'robots', 'policy', 'malformed_url', 'non_hls')""")
def p20_weak_rejections(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "rejected: No source-page target evidence").otherwise("ok").alias("reason"), F.when(F.col("toxic") == 1, "validation").otherwise("page").alias("stage"))
    return gates.weak_rejections(rows).select("doc_id")


@query("""select case when event_type = 'view' then 'HLS_master' when event_type = 'click' then 'HLS_stream' when event_type = 'error' then 'HLS_stream' else 'unknown' end as feed_type, count(*) as n from events group by 1""")
def p21_feed_type(spark, sf):
    kind = F.when(F.col("event_type") == "view", "master").when(F.col("event_type") == "click", "media")
    typed = F.when(F.col("event_type") == "error", "application/x-mpegURL")
    return table(spark, sf, "events").groupBy(gates.feed_type(kind, F.lit("https://x.example/a"), typed).alias("feed_type")).agg(F.count("*").alias("n"))


HREFS = f"""{PARTS}, hrefs as (select page_id, url, a, regexp_extract(url, '^([^:]+)', 1) as s, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[''"]([^''"]*)[''"]', 1)) as h from parts),
links as (select page_id, url, a, h, s || '://' || a || regexp_replace(h, '#.*$', '') as link from hrefs where starts_with(h, '/') and not starts_with(h, '//'))"""


@query(f"with {HREFS} select url as page, link, count(*) as n from links group by 1, 2")
def x3_page_links(spark, sf):
    return extract.page_links(table(spark, sf, "pages")).groupBy("page", "link").agg(F.count("*").alias("n"))


@query(
    f"""with {HREFS} select url as page, list_sort(list_distinct(list(link))) as links from links
  where regexp_matches(h, '(?i)^/[a-z]+$') and contains(lower(h), 'th') group by 1"""
)
def x1_stream_links(spark, sf):
    """Links of pages that match a wanted pattern, here words with th."""
    rows = extract.stream_links(table(spark, sf, "pages"), wanted=r"(?i)^https?://[^/]+/(?=[a-z]*$)[a-z]*th[a-z]*$")
    links = rows.select(F.col("url").alias("page"), F.explode("embedded").alias("link")).distinct()  # a page may be stored twice
    return links.groupBy("page").agg(F.array_sort(F.collect_list("link")).alias("links"))


@query(
    r"""with q as (select doc_id, trim(coalesce(text, '')) as q from documents), f as (select doc_id, q, regexp_extract_all(q, '(?i)(https?://\S+)', 1) as urls from q),
u as (select doc_id, q, urls, list_transform(urls, lambda x: lower(regexp_extract(x, '//([^/?#]*)', 1))) as hosts from f),
p as (select doc_id, regexp_extract(q, '(?is)^(?:.*[^\p{L}\p{N}_])?(?:from|in|near|around)((?:[^\p{L}\p{N}_].*)?)$', 1) as tail from q),
r as (select doc_id, regexp_replace(regexp_replace(tail, '(?i)(^|[^\p{L}\p{N}_])and($|[^\p{L}\p{N}_])', '\1;\2', 'g'), '(?i)(^|[^\p{L}\p{N}_])and($|[^\p{L}\p{N}_])', '\1;\2', 'g') as tail from p),
e as (
  select doc_id, 'url' as type, regexp_extract(unnest(urls), '//([^/?#]*)', 1) as name, 0.95 as confidence from u
  union all select doc_id, 'hostname', lower(unnest(list_filter(regexp_extract_all(q, '(?i)\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b', 1), lambda h: not list_contains(hosts, lower(h))))), 0.8 from u
  union all select doc_id, 'ip', unnest(regexp_extract_all(q, '\b((?:\d{1,3}\.){3}\d{1,3})\b', 1)), 0.8 from q
  union all select doc_id, 'coordinates', regexp_replace(unnest(regexp_extract_all(q, '(-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+)', 1)), '\s', '', 'g'), 0.9 from q
  union all select doc_id, 'place', unnest(list_filter(list_transform(string_split(tail, ';'), lambda t: regexp_replace(t, '^[ .,]+|[ .,]+$', '', 'g')),
    lambda t: length(t) >= 3 and not regexp_matches(t, '(?i)https?://') and not regexp_matches(t, '-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+'))), 0.7 from r)
select doc_id as id, type, lower(name) as key, confidence::double as confidence from e group by all"""
)
def x12_targets(spark, sf):
    """All kinds: URLs, hosts, addresses, coordinates and places of every document."""
    rows = extract.target_indicators(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("id", "type", F.lower("name").alias("key"), "confidence")


@query("""select h.user_id as user_id, h.k as k, h.n as n from (select user_id, cast(json_extract_string(props, '$.k') as varchar) as k, count(*) as n from events group by 1, 2) h where h.k is not null""")
def x7_json_members(spark, sf):
    doc = F.try_parse_json("props")
    rows = table(spark, sf, "events").select("user_id", files.first_member(doc, ["key", "k"]).alias("k"))
    return rows.where(F.col("k").isNotNull()).groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query(f"with {PARTS} select page_id, list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''), lambda s: lower(s)) as segments, len(list_filter(string_split(p, '/'), lambda s: s <> '')) as depth from parts")
def h6_path_segments(spark, sf):
    path = U.path(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.transform(U.segments(path), F.lower).alias("segments"), U.path_depth(F.col("url")).cast("bigint").alias("depth"))


@query(f"with {LOG}, best as (select id, arg_max(status, seq) as status from log group by id) select c_custkey as custkey, status from customer join best on cast(c_custkey as varchar) = id")
def j1_latest_probe(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_custkey").cast("string").alias("url"))
    probes = health_log(spark, sf).select(F.col("id").alias("url"), "seq", "status")
    return status.with_probe(people, probes, "seq").select("custkey", "status")


@query(
    """with hosts as (select page_id, url, regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') as d from pages)
select page_id from hosts where not (d = 'example.com' or ends_with(d, '.example.com'))"""
)
def j6_blocked_domains(spark, sf):
    blocked = spark.range(1).select(F.lit("example.com").alias("domain"))
    return gates.without_blocked(table(spark, sf, "pages"), blocked).select("page_id")


@query(
    """select doc_id from documents where not contains(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), 'in the')
  and not contains(trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g')), 'src1')"""
)
def j7_location_rules(spark, sf):
    rules = spark.range(2).select(F.when(F.col("id") == 0, "source").alias("field"), F.when(F.col("id") == 0, "SRC1").otherwise("in--the").alias("term"))
    rows = table(spark, sf, "documents").select("doc_id", "text", "source")
    ruled = gates.without_rules(rows, rules, ["text", "source"])
    return ruled.select("doc_id")


@query("select doc_id, list_filter(['erin', 'than', 'ieer', 'zzz'], lambda t: contains(lower(text), t)) as hits from documents")
def j8_term_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.term_hits(F.lower("text"), ["erin", "than", "ieer", "zzz"]).alias("hits"))


@query("select doc_id, list_filter(['for the', 'than', 'this'], lambda t: case when t = 'for the' then contains(lower(text), t) else regexp_matches(lower(text), '(^|[^a-z0-9])(?:' || t || ')($|[^a-z0-9])') end) as hits from documents")
def j9_word_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", gates.word_hits(F.col("text"), ["than", "this", "for the"]).alias("hits"))


@query(
    """select s_suppkey as seq, s_name as label, n_name as country, r_name as continent, 'country' as geo_source, 'high' as geo_confidence
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
)
def j10_geo_lookup(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("label"), F.lit("").alias("city"), F.col("n_name").alias("country"), F.lit("https://x.example/").alias("url"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.lit("country").alias("kind"), F.col("n_name").alias("key"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.col("n_name").alias("country"), F.lit("").alias("region"), F.col("r_name").alias("continent")
    )
    return geo.looked_up(rows, places).select("seq", "label", "country", F.col("geo.continent").alias("continent"), "geo_source", "geo_confidence")


@query("select s_suppkey, coalesce(r_name, 'Unknown') as continent from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def j11_continents(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    dim = n.where("n_nationkey < 20").join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("country"), F.col("r_name").alias("continent"))
    return geo.with_continent(s.select("s_suppkey", F.col("s_nationkey").cast("string").alias("country")), dim).select("s_suppkey", "continent")


@query(
    """select c_custkey, case when n_name = 'FRANCE' then 'FRANCE' end as region, case when n_name = 'FRANCE' then 'Europa' when n_name = 'CHINA' then 'Middle Kingdom' else n_name end as country
  from customer join nation on c_nationkey = n_nationkey"""
)
def j12_region_repair(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.lit("noise").alias("city"), F.lit(None).cast("string").alias("region"), F.col("n_name").alias("country"))
    one = spark.range(1)
    out = geo.repaired_regions(rows, one.select(F.lit("China").alias("alias"), F.lit("Middle Kingdom").alias("country")), one.select(F.lit("france").alias("region"), F.lit("Europa").alias("country")), ["noise"])
    return out.select("c_custkey", "region", "country")


@query(
    f"""with {KEYED}, d as (select k, min(page_id) as first_id from (select page_id, regexp_replace(k, '^https', regexp_extract(url, '^([^:]+)', 1)) as k0, k from keyed) group by k)
select domain, hits, true as needs_review from (select lower(regexp_replace(a, '^www\\.', '')) as domain, count(*) as hits from parts group by 1) where hits >= 2 and not contains(domain, 'th')"""
)
def j17_new_sources(spark, sf):
    pages = table(spark, sf, "pages")
    known = pages.select(U.domain(F.col("url")).alias("domain")).where(F.contains("domain", F.lit("th"))).distinct()
    return decisions.new_sources(pages, known)


@query(f"with {LOCATED} select count(*) as total, count(*) filter (status = 'live') as live, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'unknown') as unknown, count(*) filter (status = 'unknown' and fail_reason = 'timeout') as timeout from located")
def a1_status_counts(spark, sf):
    return reports.status_counts(located(spark, sf))


@query(f"with {LOCATED} select fail_reason, count(*) as n from located where status in ('dead', 'unknown') and fail_reason is not null group by 1")
def a2_failure_reasons(spark, sf):
    return reports.failure_reasons(located(spark, sf))


@query(
    f"""with {LOCATED} select regexp_extract(url, '//([^/?#]*)', 1) as source, count(*) as sent, count(*) filter (status = 'live') as live,
  count(*) filter (latitude is not null) as mapped, count(*) filter (latitude is null) as unknown_location from located group by 1"""
)
def a3_source_performance(spark, sf):
    rows = located(spark, sf)
    return reports.source_performance(rows, rows)


@query(
    f"""with {LOCATED} select 'sent' as stage, 'rows' as metric, count(*) as value from located union all select 'mapped', 'rows', count(*) from located where latitude is not null
  union all select 'verdict', 'status:' || status, count(*) from located group by status"""
)
def a4_funnel(spark, sf):
    rows = located(spark, sf)
    return reports.funnel([("sent", rows), ("mapped", gates.split_by_location(rows)[0])], [("verdict", rows, "status")])


@query(
    f"""with {LOCATED}, g as (select country, continent as region, city, count(*) as total from located group by all)
select country, region, city, total as m3u8, total, false as is_total from g union all select null, null, null, sum(total)::bigint, sum(total)::bigint, true from g"""
)
def a5_format_breakdown(spark, sf):
    rows = located(spark, sf).withColumnRenamed("continent", "region")
    return reports.format_breakdown(rows).select("country", "region", "city", F.col("`.m3u8`").alias("m3u8"), "total", "is_total")


@query("select regexp_extract(url, '//([^/?#]*)', 1) as domain, count(*) as n from pages group by 1")
def a6_domain_counts(spark, sf):
    return reports.domain_counts(table(spark, sf, "pages"))


@query(
    f"""with {LOCATED}, c as (select 'country' as facet, country as value, count(*) as n from located group by 2 order by n desc, value limit 15)
select * from c union all select 'status', status, count(*) from located group by 2 union all select 'location', case when latitude is null then 'unlocated' else 'located' end, count(*) from located group by 2"""
)
def a8_profile(spark, sf):
    return reports.profile(located(spark, sf), [("country", 15), ("status", None)])


@query(
    """select case when quality = 1 then 'page' else 'stream' end as stage, count(*) filter (toxic = 0 and doc_id % 3 > 0) as accept, count(*) filter (toxic = 1) as reject,
  count(*) filter (toxic = 0 and doc_id % 3 = 0) as review, 0::bigint as fallback, count(*) filter (doc_id % 5 = 0) as timeout, 0::bigint as parse_error from labels group by 1"""
)
def a9_decision_counts(spark, sf):
    d = table(spark, sf, "labels")
    made = F.when(F.col("toxic") == 1, "reject").when(F.col("doc_id") % 3 > 0, "accept").otherwise("review")
    rows = d.select(F.when(F.col("quality") == 1, "page").otherwise("stream").alias("stage"), made.alias("decision"), F.when(F.col("doc_id") % 5 == 0, "LLM timeout").alias("reason"))
    return reports.decision_counts(rows)


@query("select source as artifact, 'lang' as \"column\", lang as value, count(*) as n from documents where lang is not null group by all")
def a10_artifact_counts(spark, sf):
    return reports.artifact_counts(table(spark, sf, "documents").withColumnRenamed("source", "artifact"), "artifact", ["lang"])


@query("select source, 'first' as error, sum(len(regexp_extract_all(text, '(?i)erin|than')))::bigint as n from documents group by 1 union all select source, 'second', sum(len(regexp_extract_all(text, '(?i)tion')))::bigint from documents group by 1")
def a11_error_counts(spark, sf):
    return reports.error_counts(table(spark, sf, "documents"), "source", "text", [("first", "erin|than"), ("second", "tion")])


@query(
    """with m as (select 'orders_' || o_orderpriority as metric, count(*)::double as value from orders group by 1), c as (select * from (values ('low', 10.0, 'low'), ('all', 3010.0, 'orders')) v(cap_name, cap_value, hint))
select metric, value, cap_name, cap_value::double as cap_value from m join c on contains(lower(metric), lower(hint)) and value > cap_value"""
)
def a12_cap_audit(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.concat(F.lit("orders_"), "o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return reports.cap_audit(m, spark.createDataFrame([("low", 10.0, "low"), ("all", 3010.0, "orders")], "cap_name string, cap_value double, hint string"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 3) * 40).cast("int"))).cast("smallint"))
    return table(spark, sf, "embeddings").select(F.concat(F.lit("s"), "label").alias("url"), F.col("vec_id").alias("frame_no"), pixels.alias("pixels"))


FRAMES = "frames as (select 's' || label as url, vec_id as frame_no, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::double + 3) * 40)::int))) as pixels from embeddings)"


@query(
    f"""with {FRAMES}, px as (select url, frame_no, unnest(pixels) as v from frames), h as (select url, frame_no, v, count(*) as c from px group by all),
n as (select url, frame_no, sum(c) as n, sum(v * c) / sum(c) as mean, sqrt(greatest(sum(v * v * c) / sum(c) - (sum(v * c) / sum(c)) ** 2, 0)) as std, sum(case when v < 12 then c else 0 end) / sum(c) as dark_share from h group by all),
e as (select url, frame_no, sum(-(c / n) * log2(c / n)) as entropy from h join n using (url, frame_no) group by all)
select url, frame_no, round(mean, 6) as mean, round(std, 6) as std, round(dark_share, 6) as dark_share, round(entropy, 6) as entropy from n join e using (url, frame_no)"""
)
def a13_frame_metrics(spark, sf):
    rows = status.frame_metrics(frames(spark, sf))
    return rows.select("url", "frame_no", *[F.round(c, 6).alias(c) for c in ("mean", "std", "dark_share", "entropy")])


@query(
    f"""with {FRAMES}, d as (select url, frame_no, pixels, lag(pixels) over (partition by url order by frame_no) as b from frames)
select url, frame_no, round(list_sum(list_transform(range(1, 65), lambda i: abs(pixels[i] - b[i]))) / 64, 6) as diff from d where b is not null"""
)
def e4_frame_differences(spark, sf):
    return status.frame_differences(frames(spark, sf)).select("url", "frame_no", F.round("diff", 6).alias("diff"))


@query("select 's' || label as url, 'live' as frame_status, 'frames_ok' as detail from embeddings group by 1")
def a14_frame_verdicts(spark, sf):
    return status.frame_verdicts(frames(spark, sf)).select("url", "frame_status", "detail")


@query(f"with {LOCATED} select floor(latitude / 10)::bigint as lat_cell, floor(longitude / 10)::bigint as lon_cell, count(*) as n from located where latitude is not null group by 1, 2")
def a20_density(spark, sf):
    return geo.density(located(spark, sf), 10.0)


@query(f"with {KEYED} select k as key, min(page_id) as seq, arg_min(url, page_id) as url from keyed group by k")
def e1_first_wins(spark, sf):
    return windows.first_wins(candidates(spark, sf).withColumn("key", U.catalogue_key(F.col("url"))), ["key"]).select("key", "seq", "url")


@query(f"with {KEYED} select k as key, min(page_id) as seq, arg_max(url, page_id) as url from keyed group by k")
def e2_last_wins(spark, sf):
    return windows.last_wins(candidates(spark, sf).withColumn("key", U.catalogue_key(F.col("url"))), ["key"]).select("key", "seq", "url")


STREAKS = f"""{LOG}, runs as (select *, sum(case when status = 'live' then 1 else 0 end) over (partition by id order by ts, seq rows unbounded preceding) as run from log),
streaks as (select id, seq, ts, status, sum(case when status = 'dead' then 1 else 0 end) over (partition by id, run order by ts, seq rows unbounded preceding)::bigint as streak from runs)"""


@query(f"with {STREAKS} select id, seq, streak from streaks")
def e3_failure_streaks(spark, sf):
    return windows.failure_streaks(health_log(spark, sf), order=("ts", "seq")).select("id", "seq", "streak")


@query(f"with {LOG}, c as (select id, seq, status, lag(status) over (partition by id order by ts, seq) as old_status from log) select * from c where old_status <> status")
def e6_status_changes(spark, sf):
    return windows.status_changes(health_log(spark, sf), order=("ts", "seq")).select("id", "seq", "status", "old_status")


@query(f"with {STREAKS} select id, seq, streak from streaks where streak >= 2")
def e7_review_queue(spark, sf):
    return windows.review_queue(windows.failure_streaks(health_log(spark, sf), order=("ts", "seq")), 2).select("id", "seq", "streak")


@query("select page_id as seq, ceil(row_number() over (order by page_id) / 10)::int as batch from pages qualify batch <= 5")
def e9_batches(spark, sf):
    return windows.numbered_batches(candidates(spark, sf), ["seq"], 10, 5)[0].select("seq", "batch")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def e10_top_per_group(spark, sf):
    return windows.top_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query(f"with {LOG} select id, list(seq order by seq) as last_values from (select * from log qualify row_number() over (partition by id order by seq desc) <= 5) group by id")
def e11_keep_last(spark, sf):
    return windows.keep_last(health_log(spark, sf).select("id", "seq", F.col("seq").alias("v")), ["id"], "seq", "v", 5)


@query(f"with {LOG} select id, arg_max(status, seq) as status, round(sum(value), 4) as value from log group by id")
def e12_latest_metrics(spark, sf):
    return windows.latest_metrics(health_log(spark, sf), "id", "seq", ["status"], ["value"]).withColumn("value", F.round("value", 4))


@query("select c_mktsegment as value, count(*) as n from customer group by 1 order by n desc, min(c_custkey) limit 3")
def t2_top_counts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("seq"))
    return windows.top_counts(rows, "value", "seq", 3)


@query(f"with {HREFS}, f as (select url as page, link, len(list_filter(string_split(regexp_extract(link, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) as depth from links group by all) select page, link, depth from f qualify row_number() over (partition by page order by depth, link) <= 4")
def t4_shallow_links(spark, sf):
    rows = extract.same_domain_links(table(spark, sf, "pages")).withColumn("pos", F.col("link"))
    return windows.shallow_links(rows, 4).select("page", "link", F.col("depth").cast("bigint").alias("depth"))


@query(
    """with p as (select l_orderkey as seq, 'https://x.example/' || l_orderkey || '.m3u8' as candidate_url, case when l_returnflag = 'R' then 'https://traffic.example/dot' end as source_page, l_discount * 10 as rel from lineitem),
s as (select seq, least(0.5, 0.2 * (case when source_page is null then 0 else 1 end)) as t, least(0.2, 0.1 * (1 + case when source_page is null then 0 else 1 end)) as c, rel from p),
z as (select seq, 0.2 + t + c + 0.2 + least(0.1, rel * 0.1) as score from s)
select seq, case when score >= 0.7 then 'high' when score >= 0.45 then 'medium' else 'low' end as priority, count(*) as n from z group by all"""
)
def c1_priorities(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("https://x.example/"), "l_orderkey", F.lit(".m3u8")).alias("candidate_url"), F.when(F.col("l_returnflag") == "R", "https://traffic.example/dot").alias("source_page"),
                     F.lit(None).cast("string").alias("root_url"), F.lit(None).cast("string").alias("source_query"), (F.col("l_discount") * 10).alias("page_relevance_score"))
    return gates.priorities(rows, locations=["dot"]).groupBy("seq", "priority").agg(F.count("*").alias("n"))


@query(
    """with w as (select doc_id, lower(text) as t from documents), s as (select doc_id,
  len(list_filter(['camera', 'cctv', 'traffic', 'webcam', 'stream', 'live', 'map', 'region', '511', 'dot', 'turnpike'], lambda x: contains(t, x))) as pos,
  len(list_filter(['privacy', 'terms', 'careers', 'login', 'signup', 'press', 'blog', 'news', 'pdf', 'job'], lambda x: contains(t, x))) as neg,
  len(list_filter(['erin', 'than'], lambda x: contains(t, x))) as loc from w)
select doc_id, round(least(1.0, 0.2 * pos - 0.2 * neg + 0.2 * least(loc, 2)), 6)::double as relevance_score, round(least(1.0, 0.15 * pos - 0.2 * neg + case when loc > 0 then 0.15 else 0 end), 6)::double as camera_likelihood_score from s"""
)
def c3_triage(spark, sf):
    return gates.triage(table(spark, sf, "documents").select("doc_id", "text"), ["erin", "than"], ["text"]).select("doc_id", "relevance_score", "camera_likelihood_score")


@query("""select event_id, case when event_type = 'error' then 'dead' when event_type = 'view' then 'live' when event_type = 'click' then 'unknown' when event_type = 'signup' then 'dead' else 'unknown' end as status,
  case when event_type = 'error' then 'http_404' when event_type = 'click' then 'http_301' when event_type = 'signup' then 'auth_required' when event_type = 'view' then null else 'timeout' end as fail_reason from events""")
def c7_http_status(spark, sf):
    code = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 301).when(F.col("event_type") == "signup", 403)
    return table(spark, sf, "events").select("event_id", gates.http_status(code, F.lit(True)).alias("v")).select("event_id", "v.*")


@query("""select user_id as item_id, count(*) as n from events where event_type in ('view', 'click') group by 1""")
def c4_scope_decisions(spark, sf):
    e = table(spark, sf, "events")
    word = F.when(F.col("event_type").isin("view", "click"), "Approved").otherwise("maybe")
    raw = e.select(F.col("event_id").alias("item_id"), "user_id", F.concat(F.lit('Sure: ```json {"decision": "'), word, F.lit('", "confidence": 85}```')).alias("raw"))
    made = decisions.scope_decisions(raw, raw).where("decision = 'accept' and confidence = 0.85")
    return made.join(raw.select("item_id", "user_id"), "item_id").groupBy(F.col("user_id").alias("item_id")).agg(F.count("*").alias("n"))


@query(
    """with cells as (select s_suppkey as i, case s_suppkey % 4 when 2 then 89.999 + (s_suppkey // 4 % 10) * 0.0001 when 3 then -89.9997 else (s_suppkey // 4 % 10) * 0.0003 end as lat,
  case s_suppkey % 4 when 0 then (s_suppkey // 40 % 10) * 0.0003 when 1 then case when s_suppkey // 4 % 2 = 0 then 179.9998 else -179.9998 end else (s_suppkey % 7) * 51.0 - 153.0 end as lon,
  'c' || (s_suppkey % 3) as city from supplier),
classes as (select city, lat, lon, min(i) as cls, count(*) as n from cells group by all),
near as (select a.cls, sum(b.n) - 1 as n_links from classes a join classes b on a.city = b.city
where 2 * 6371000.0 * atan2(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2),
  sqrt(1 - (sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 120 group by a.cls)
select i as seq, cls, n_links::bigint as n_links from cells join classes using (city, lat, lon) join near using (cls)"""
)
def j20_proximity(spark, sf):
    """Of each record the class of its place and how many others lie within 120 m; places at the equator, on both sides of the 180th meridian and at the poles."""
    k = F.col("s_suppkey")
    part = F.floor(k / 4)
    lat = F.when(k % 4 == 2, 89.999 + part % 10 * 0.0001).when(k % 4 == 3, -89.9997).otherwise(part % 10 * 0.0003)
    lon = F.when(k % 4 == 0, F.floor(k / 40) % 10 * 0.0003).when(k % 4 == 1, F.when(part % 2 == 0, 179.9998).otherwise(-179.9998)).otherwise(k % 7 * 51.0 - 153.0)
    rows = table(spark, sf, "supplier").select(k.alias("seq"), lat.alias("latitude"), lon.alias("longitude"), F.concat(F.lit("c"), k % 3).alias("city"))
    members = resolve.places(rows)
    return resolve.links_of(members, resolve.proximity_edges(members, 120.0))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as records: the whole title is the label, the host the city."""
    k, host = F.col("page_id"), U.domain(F.col("url"))
    return table(spark, sf, "pages").select(
        k.alias("seq"), "url", host.alias("city"), F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1).alias("label"),
        F.when(k % 4 == 0, (k % 100) / 10000.0).alias("latitude"), F.when(k % 4 == 0, F.lit(7.5)).alias("longitude"), F.array(host).alias("source_refs"), F.lit("2026-01-01").alias("last_verified"),
    )


@query()
def d1_entity_resolution(spark, sf):
    """Greedy absorption in arrival order; a test holds it against the sequential loop."""
    return resolve.deduplicate(entities(spark, sf)).select("seq", "url", "merged_rows", "source_refs")


@query()
def j21_similar_labels(spark, sf):
    """Of each record the class of its label and how many others of its city have an alike one; a test holds it against all pairs."""
    members = resolve.labels(entities(spark, sf))
    return resolve.links_of(members, resolve.label_edges(members))


@query(
    f"""with recursive {HREFS}, steps as (select distinct url as page, link from links where not regexp_matches(lower(link), 'privacy|terms|careers|login|signup')),
reach(root, url, depth) as (select distinct url, url, 0 from pages union select r.root, s.link, r.depth + 1 from reach r join steps s on r.url = s.page where r.depth < 5),
least as (select root, url, min(depth) as depth from reach group by root, url),
parents as (select l.root, l.url, l.depth, min(u.url) as parent from least l left join steps s on s.link = l.url left join least u on u.root = l.root and u.url = s.page and u.depth = l.depth - 1 group by all)
select root, url, depth, parent from parents qualify row_number() over (partition by root order by depth, url) <= 250"""
)
def g1_link_graph(spark, sf):
    """Links of pages on their own hosts, from every page, to the operator's own depth and number of pages."""
    pages = table(spark, sf, "pages")
    return graph.expand(pages.select("url"), extract.same_domain_links(pages))


@query(f"with {LOCATED} select count(*) as total, count(*) filter (status = 'live') as live, count(*) filter (status = 'dead') as dead, count(*) filter (status not in ('live', 'dead')) as unknown, count(*) filter (latitude is null) as unmapped, 'x' as generated from located")
def s6_geojson_metadata(spark, sf):
    return files.geojson_metadata(located(spark, sf), "x")


@query(f"with {LOCATED} select id, latitude, longitude, country, status from located where latitude is not null")
def s5_geojson_round_trip(spark, sf):
    features = files.geojson_features(located(spark, sf)).select(F.try_parse_json("feature").alias("f"))
    return files.split_features(features)[0].select("id", "latitude", "longitude", "country", "status")


@query(f"with {LOCATED} select continent, country, city, list_sort(list(label)) as labels from located group by all")
def s7_grouped_catalogue(spark, sf):
    rows = located(spark, sf).withColumns({"feed_type": F.lit("HLS_stream"), "notes": F.lit("")})
    return files.grouped_catalogue(rows).select("continent", "country", "city", F.transform("items", lambda i: i["label"]).alias("labels"))


@query(
    """with d as (select event_id % 9 as depth, event_id % 4 as many, json_extract_string(props, '$.k') as v from events),
leaves as (select repeat('n.', depth) || 'k' as key, v as value from d union all select repeat('n.', depth) || 'list.len', many::varchar from d union all select 'id', depth::varchar from d where depth > 0)
select key, value, count(*) as n from leaves group by all"""
)
def s4_flattened(spark, sf):
    """The events' own properties beside a list, nested up to eight objects deep, each with a member of its own at the top."""
    k = F.col("event_id")
    inner = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "list": ['), F.array_join(F.array_repeat(F.lit("{}"), (k % 4).cast("int")), ","), F.lit("]}"))
    depth = (k % 9).cast("int")
    nested = F.concat(F.repeat(F.lit('{"n":'), depth), inner, F.repeat(F.lit("}"), depth))
    nested = F.when(depth > 0, F.concat(F.regexp_replace(nested, r"\}$", ""), F.lit(', "id": '), depth, F.lit("}"))).otherwise(nested)
    docs = table(spark, sf, "events").select(F.try_parse_json(nested).alias("doc"))
    return files.flattened(docs).groupBy("key", "value").agg(F.count("*").alias("n"))


@query(f"with {LOCATED} select id, latitude, longitude, country, status from located where latitude is not null")
def s5_geojson_scan(spark, sf):
    """Collections of about a thousand features each, written as text and scanned."""
    rows = located(spark, sf)
    parts = rows.count() // 1000 + 1
    features = files.geojson_features(rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))))
    part = F.get_json_object("feature", "$.properties._part")
    folder = f"{shared_dir(spark)}/tessera-geojson-{uuid.uuid4().hex}"
    collections = features.groupBy(part.alias("part")).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("feature"), ",\n"), F.lit('], "metadata": {"generated": "x"}}')).alias("value"))
    collections.select("value").write.text(folder)
    return files.read_geojson(spark, folder)[0].select("id", "latitude", "longitude", "country", "status")


@query("select doc_id, upper(substr(sha1(text), 1, 10)) as h, case when length(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <= 40 then regexp_replace(text, '[\\r\\n]+', ' ', 'g') else substr(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 1, 37) || '...' end as short from documents")
def h10_hash_and_shorten(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.upper(X.short_hash(F.col("text"))).alias("h"), X.shortened(F.col("text"), 40).alias("short"))


def queries() -> dict[str, Query]:
    from tessera import queries_observed  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


