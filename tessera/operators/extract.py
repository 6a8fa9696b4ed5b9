"""Extraction jobs: one row of a page, feed, playlist, query or log gives any number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.functions.text import shortened

#: Where pages hold stream links, in the order of their standing (fixed values); {x} is the wanted extension.
LINK_PATTERNS = (
    r"(?is)<(?:source|video)\b[^>]*?\bsrc\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?is)jwplayer\s*\([^)]*\)\s*\.setup\s*\(\s*\{[^}]*['\"]file['\"]\s*:\s*['\"]([^'\"]+)['\"]",
    r"(?i)hls\.loadSource\s*\(\s*['\"]([^'\"]+)['\"]",
    r"(?i)(?:streamUrl|hlsUrl|videoSrc|stream_url|hls_url)\s*[=:]\s*['\"]([^'\"]+)['\"]",
    r"(?i)data-cam-url\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?i)data-stream\s*=\s*['\"]([^'\"]+)['\"]",
    r"(?i)data-src\s*=\s*['\"]([^'\"]+{x}[^'\"]*)['\"]",
    r"(?i)['\"]([^'\"]{{4,500}}{x}[^'\"]{{0,100}})['\"]",
    r"(?is)<a\b[^>]*?\bhref\s*=\s*['\"]([^'\"]+)['\"]",
)
#: Hosts whose frames are never followed (fixed values).
SKIP_FRAME_DOMAINS = (
    "youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "tiktok.com",
    "doubleclick.net", "googlesyndication.com", "google.com", "maps.google.com", "openstreetmap.org", "disqus.com",
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _patterns(extension: str) -> list[str]:
    x = "".join("\\" + c if not c.isalnum() else c for c in extension)
    return [p.replace("{x}", x).replace("{{", "{").replace("}}", "}") for p in LINK_PATTERNS]


def stream_links(pages: DataFrame, url: str = "url", html: str = "html", extension: str = ".m3u8", wanted: str | None = None) -> DataFrame:
    """Add embedded: ARRAY of distinct stream links of a page in the order found, and direct: the first of them.

    wanted is the pattern that a made-absolute link must match; by default the extension, before its
    query or the end.
    """
    x = "".join("\\" + c if not c.isalnum() else c for c in extension)
    wanted = wanted or rf"(?i){x}(\?|#|$)"
    page = F.coalesce(F.col(html), F.lit(""))
    found = F.concat(*[_all(page, p) for p in _patterns(extension)])
    made = F.transform(found, lambda raw: U.normalised_link(raw, F.col(url), extension))
    kept = F.array_distinct(F.filter(made, lambda u: u.rlike(wanted)))
    return pages.withColumn("embedded", kept).withColumn("direct", F.get("embedded", F.lit(0)))


def expand_candidates(candidates: DataFrame, pages: DataFrame, extension: str = ".m3u8", wanted: str | None = None) -> DataFrame:
    """Candidates that are pages become their streams.

    A page's first stream takes the candidate's place, the page joins its source_refs; each further
    one is a candidate of its own, noted `embedded_in:`, without state_region. A page without streams, or
    that wasn't stored, stays as it is.
    """
    links = stream_links(pages.select("url", "html"), extension=extension, wanted=wanted).select("url", "embedded")
    joined = candidates.join(links, "url", "left")
    many = joined.select("*", F.posexplode_outer("embedded").alias("pos", "stream"))
    return many.select(
        *[c for c in candidates.columns if c not in ("url", "source_refs", "notes", "state_region")],
        F.coalesce("stream", "url").alias("url"),
        F.when(F.col("stream").isNull(), F.col("source_refs")).otherwise(F.array_distinct(F.array_append(F.coalesce("source_refs", F.array().cast("array<string>")), F.col("url")))).alias("source_refs"),
        F.when(F.col("pos") > 0, F.concat(F.lit("embedded_in:"), "url")).otherwise(F.col("notes")).alias("notes"),
        F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("state_region")).alias("state_region"),
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, href, text, link): every anchor with its text and its absolute http(s) link without fragment."""
    anchors = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*['\"]([^'\"]*)['\"][^>]*>(?:.*?)</a>"), F.lit(0))
    rows = pages.select(F.col(url).alias("page"), F.posexplode(anchors).alias("pos", "anchor"))
    href = F.regexp_extract("anchor", r"(?is)\bhref\s*=\s*['\"]([^'\"]*)['\"]", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("anchor", "<[^>]*>", ""), r"\s+", " "))
    rows = rows.select("page", "pos", href.alias("href"), text.alias("text"))
    link = F.regexp_replace(U.resolved(F.trim("href"), F.col("page")), "#.*$", "")
    return rows.withColumn("link", link).where(F.col("link").rlike("(?i)^https?://"))


def same_domain_links(pages: DataFrame, city: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """page_links() that stay on the page's authority, with depth and the places their path names; distinct, first seen.

    With city only links that have it in the href or the text.
    """
    rows = page_links(pages, url, html).where(U.authority(F.col("link")) == U.authority(F.col("page")))
    if city:
        rows = rows.where(F.contains(F.lower("href"), F.lit(city.lower())) | F.contains(F.lower("text"), F.lit(city.lower())))
    first = rows.groupBy("page", "link").agg(F.min(F.struct("pos", "text")).alias("one"))
    geo = U.geo_hierarchy(F.col("link"))
    return first.select(
        "page",
        "link",
        F.col("one.pos").alias("pos"),
        F.col("one.text").alias("text"),
        U.path_depth(F.col("link")).alias("depth"),
        geo["country"].alias("country"),
        geo["region"].alias("region"),
        geo["city"].alias("city"),
        F.array("page").alias("source_refs"),
    )


def pagination_links(pages: DataFrame, most: int = 5, url: str = "url", html: str = "html") -> DataFrame:
    """(page, n, link): the first links of a page that lead to its next ones, by their words or a page number."""
    rows = page_links(pages, url, html)
    next_word = F.col("text").rlike(r"(?iu)next|›|»|more|следующая")
    rows = rows.where(next_word | F.col("href").rlike(r"(?i)page=\d+|/page/\d+"))
    per_page = rows.groupBy("page").agg(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"])), 1, most).alias("links"))
    return per_page.select("page", F.posexplode("links").alias("n", "link"))


def frame_streams(pages: DataFrame, extension: str = ".m3u8", wanted: str | None = None, skip: Sequence[str] = SKIP_FRAME_DOMAINS) -> DataFrame:
    """(page, frame, stream): for pages without a stream, the first frame whose stored page has one. One level."""
    linked = stream_links(pages.select("url", "html"), extension=extension, wanted=wanted)
    bare = linked.where(F.col("direct").isNull())
    sources = _all(F.coalesce("html", F.lit("")), r"(?is)<iframe\b[^>]*?\bsrc\s*=\s*['\"]([^'\"]+)['\"]")
    frames = bare.select(F.col("url").alias("page"), F.posexplode(F.transform(sources, lambda s: U.normalised_link(s, F.col("url"), extension))).alias("pos", "frame"))
    host = F.lower(U.domain(F.col("frame")))
    skipped = F.lit(False)
    for d in skip:
        skipped = skipped | (host == d) | F.endswith(host, F.lit("." + d))
    found = frames.where(~skipped).join(linked.where(F.col("direct").isNotNull()).select(F.col("url").alias("frame"), "direct"), "frame")
    return found.groupBy("page").agg(F.min_by(F.struct("frame", "direct"), "pos").alias("one")).select("page", "one.frame", F.col("one.direct").alias("stream"))


def feed_endpoints(texts: DataFrame, text: str = "text", order: str = "seq", synthetic: tuple[str, Sequence[str]] | None = None, most: int = 100) -> DataFrame:
    """(endpoint, first_seq): JSON and GeoJSON feeds and ArcGIS layers named in texts, those of the first text first, then by name.

    synthetic: (pattern, endpoints) adds the endpoints for texts in which the pattern occurs.
    """
    page = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(
        _all(page, r"(?i)(https?://[^\s'\"]+\.(?:geojson|json))"),
        _all(page, r"(?i)(https?://[^\s'\"]+/(?:FeatureServer|MapServer)/\d+)"),
    )
    if synthetic:
        pattern, more = synthetic
        found = F.concat(found, F.when(page.rlike(pattern), F.array(*[F.lit(m) for m in more])).otherwise(F.array().cast("array<string>")))
    rows = texts.select(F.col(order).alias("seq"), F.explode(F.array_distinct(found)).alias("endpoint"))
    return rows.groupBy("endpoint").agg(F.min("seq").alias("first_seq")).orderBy("first_seq", "endpoint").limit(most)


def _walk(value: Column, levels: int) -> Column:
    """Strings inside a variant, of objects and arrays down to `levels`, as one array."""
    text = F.array(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
    if not levels:
        return text
    members = F.map_values(F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    deeper = F.flatten(F.transform(F.concat(members, items), lambda v: _walk(v, levels - 1)))
    return F.concat(text, deeper)


def _first(value: Column, *names: str) -> Column:
    """The first of several members that isn't missing or empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in names])


def feed_records(payloads: DataFrame, endpoint: str = "endpoint", body: str = "body", pattern: str = r"(?i)\.m3u8", levels: int = 3, most: int | None = 3000) -> DataFrame:
    """(endpoint, pos, stream, name, record_id, latitude, longitude, raw): records of JSON feeds that hold a stream.

    A payload is a list, or an object whose first non-empty member of features, data, cameras is one. A
    record's `properties` are taken out; its stream is the first string that matches, by member name,
    down to `levels`; coordinates fall back to the geometry's. Bodies that aren't JSON give nothing.
    """
    parsed = payloads.select(F.col(endpoint).alias("endpoint"), F.try_parse_json(F.col(body)).alias("doc"))
    lists = [F.try_variant_get("doc", p, "array<variant>") for p in ("$", "$.features", "$.data", "$.cameras")]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = parsed.select("endpoint", F.posexplode(chosen).alias("pos", "whole"))
    inner = F.coalesce(F.try_variant_get("whole", "$.properties", "variant"), F.col("whole"))
    rows = rows.withColumn("raw", inner)
    texts = F.filter(_walk(F.col("raw"), levels), lambda t: t.isNotNull() & t.rlike(pattern))
    point = F.try_variant_get("whole", "$.geometry.coordinates", "array<double>")
    out = rows.select(
        "endpoint",
        "pos",
        F.get(texts, F.lit(0)).alias("stream"),
        _first(F.col("raw"), "name", "camera_name", "title", "description", "location").alias("name"),
        _first(F.col("raw"), "id", "camera_id", "record_id").alias("record_id"),
        F.coalesce(_first(F.col("raw"), "latitude", "lat").try_cast("double"), F.get(point, F.lit(1))).alias("latitude"),
        F.coalesce(_first(F.col("raw"), "longitude", "lon", "lng").try_cast("double"), F.get(point, F.lit(0))).alias("longitude"),
        F.to_json("raw").alias("raw"),
    ).where(F.col("stream").isNotNull())
    return out.orderBy("endpoint", "pos").limit(most) if most else out


def feed_candidates(records: DataFrame, page: str | None = None) -> DataFrame:
    """Candidates of feed_records(): coordinates come with them, refs are the endpoint and the page it was found on."""
    refs = [F.col("endpoint")] + ([F.lit(page)] if page else [])
    return records.select(
        F.col("stream").alias("url"),
        F.col("name").alias("label"),
        "latitude",
        "longitude",
        F.col("endpoint").alias("feed_endpoint"),
        F.col("record_id").alias("source_record_id"),
        F.lit("coordinate_source: feed").alias("notes"),
        F.array(*refs).alias("source_refs"),
        F.col("raw").alias("raw_metadata"),
    )


def script_endpoints(scripts: DataFrame, text: str = "body", base: str = "script_url", extension: str = ".m3u8") -> DataFrame:
    """(base, kind, endpoint): stream links and API endpoints in script texts, made absolute."""
    x = "".join("\\" + c if not c.isalnum() else c for c in extension)
    body = F.coalesce(F.col(text), F.lit(""))
    streams = _all(body, rf"(?i)((?:https?://|/)[^'\"\s]+{x}[^'\"\s]*)")
    calls = _all(body, r"(?i)['\"]((?:https?://[^'\"\s]+|/[^'\"\s]*)?(?:/api/|GetCamera)[^'\"\s]*)['\"]")
    both = F.concat(
        F.transform(streams, lambda u: F.struct(F.lit("stream").alias("kind"), u.alias("u"))), F.transform(calls, lambda u: F.struct(F.lit("api").alias("kind"), u.alias("u")))
    )
    rows = scripts.select(F.col(base).alias("base"), F.explode(both).alias("e"))
    return rows.select("base", "e.kind", U.resolved(F.col("e.u"), F.col("base")).alias("endpoint")).distinct()


def playlist_variants(playlists: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, n, variant): for each stream entry of a master playlist the next line that is no tag, absolute, distinct in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(body), F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    marked = F.filter(lines, lambda s: F.startswith(s, F.lit("#EXT-X-STREAM-INF")) | ~F.startswith(s, F.lit("#")))
    # one value of a list of one, so that both uses share it
    pairs = F.transform(F.array(marked), lambda m: F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.when(F.startswith(a, F.lit("#EXT-X-STREAM-INF")) & ~F.startswith(b, F.lit("#")), b)))[0]
    found = F.array_distinct(F.transform(F.filter(pairs, lambda s: s.isNotNull()), lambda s: U.resolved(s, F.col(url))))
    # not the inner one: Spark would work the list out again, twice, to leave out rows without any
    rows = playlists.withColumn("_found", found).select(F.col(url).alias("url"), F.posexplode_outer("_found").alias("n", "variant"))
    return rows.where(F.col("n").isNotNull())


#: Words of URLs that name no place (fixed values).
TECHNICAL_TOKENS = (
    "playlist", "stream", "hls", "m3u8", "live", "camera", "cam", "video", "index", "master", "manifest", "chunk", "segment", "cdn",
    "play", "player",
)


def url_metadata(urls: DataFrame, url: str = "url", label: str | None = None, most: int = 10) -> DataFrame:
    """Add cleaned_tokens, technical_tokens, location_phrases (text, confidence) and label_hint from a URL's words.

    Words come from path, parameter names and values, and fragment, decoded and split at case changes,
    digits and _-./; a phrase is a word, or two neighbours of three letters and more, in title case,
    distinct; two words are of high confidence. label_hint is null if there is no phrase.
    """
    u = F.col(url)
    pairs = U.query_pairs(u)
    raw = F.concat(
        U.segments(U.path(u)), F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"]), F.when(U.fragment(u) != "", F.array(U.fragment(u))).otherwise(F.array().cast("array<string>"))
    )

    def words(token: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(U.decoded(token), r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z])(\d)|(\d)([A-Za-z])", "$1$3 $2$4")
        return F.split(F.regexp_replace(spaced, r"[_\-./\s]+", " "), " ")

    every = F.filter(F.flatten(F.transform(raw, lambda t: F.transform(words(t), lambda w: F.lower(F.trim(w))))), lambda w: w != "")
    technical = F.array(*[F.lit(t) for t in TECHNICAL_TOKENS])
    out = urls.withColumn("_every", every)
    out = out.withColumn("cleaned_tokens", F.filter("_every", lambda w: ~F.array_contains(technical, w)))
    out = out.withColumn("technical_tokens", F.array_sort(F.array_distinct(F.filter("_every", lambda w: F.array_contains(technical, w)))))
    long = F.filter("cleaned_tokens", lambda w: (F.length(w) >= 3) & w.rlike("[a-z]"))
    pairs_of = F.zip_with(long, F.slice(long, 2, 1 << 20), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    phrases = F.array_distinct(
        F.flatten(F.transform(pairs_of, lambda p: F.filter(F.array(p["a"], F.when(p["b"].isNotNull(), F.concat_ws(" ", p["a"], p["b"]))), lambda x: x.isNotNull())))
    )
    titled = F.transform(phrases, lambda p: U.title_case(p))
    out = out.withColumn(
        "location_phrases",
        F.transform(F.slice(titled, 1, most), lambda p: F.struct(p.alias("text"), F.when(F.contains(p, F.lit(" ")), "high").otherwise("medium").alias("confidence"))),
    )
    first = F.get(titled, F.lit(0))
    return out.withColumn("label_hint", F.when(F.size(titled) > 0, F.coalesce(F.col(label), first) if label else first)).drop("_every")


#: Queries that name no target, other names of places (fixed values).
GENERIC_QUERIES = ("find public hls cameras", "get all webcams", "find live traffic cameras", "find m3u8 feeds", "search for webcams")
ALIASES = (("pennsylvania", ("PA",)), ("united kingdom", ("UK", "Britain")))


def target_indicators(queries: DataFrame, id: str = "query_id", query: str = "query", planned: str | None = None) -> DataFrame:
    """(id, n, type, name, aliases, confidence): what a query text points at, distinct by type and name.

    URLs, host names not already seen in them, IPv4 addresses, coordinates, places after from, in, near or
    around, and the planner's places. A generic or empty query points at nothing.
    """
    q = F.trim(F.coalesce(F.col(query), F.lit("")))
    found_urls = _all(q, r"(?i)(https?://\S+)")
    hosts = F.filter(_all(q, r"(?i)\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), lambda h: ~F.array_contains(F.transform(found_urls, lambda u: F.lower(U.authority(u))), F.lower(h)))
    addresses = _all(q, r"\b((?:\d{1,3}\.){3}\d{1,3})\b")
    points = F.transform(_all(q, r"(-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+)"), lambda c: F.regexp_replace(c, r"\s", ""))
    pieces = F.split(q, r"(?iU)\b(?:from|in|near|around)\b")
    tail = F.when(F.size(pieces) > 1, F.element_at(pieces, -1)).otherwise("")
    places = F.filter(
        F.transform(F.split(tail, r"(?iU)\band\b|;"), lambda t: F.regexp_replace(t, r"^[ .,]+|[ .,]+\z", "")),
        lambda t: (F.length(t) >= 3) & ~t.rlike(r"(?i)https?://") & ~t.rlike(r"-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+"),
    )

    def kind(values: Column, name: str, confidence: float, shown=lambda v: v) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("type"), shown(v).alias("name"), F.lit(confidence).alias("confidence")))

    every = [
        kind(found_urls, "url", 0.95, U.authority),
        kind(hosts, "hostname", 0.8, F.lower),
        kind(addresses, "ip", 0.8),
        kind(points, "coordinates", 0.9),
        kind(places, "place", 0.7),
    ]
    if planned:
        every.append(kind(F.filter(F.coalesce(F.col(planned), F.array().cast("array<string>")), lambda p: p != ""), "place", 0.75))
    generic = F.lower(q).isin(*GENERIC_QUERIES)
    rows = queries.where(~generic).select(F.col(id).alias("id"), F.posexplode(F.concat(*every)).alias("pos", "t"))
    first = rows.groupBy("id", "t.type", F.lower("t.name").alias("key")).agg(F.min(F.struct("pos", F.col("t.name").alias("name"), F.col("t.confidence").alias("confidence"))).alias("one"))
    aliases = F.lit(None).cast("array<string>")
    for name, others in ALIASES:
        aliases = F.when(F.col("key") == name, F.array(*[F.lit(o) for o in others])).otherwise(aliases)
    aliases = F.when(F.col("type") == "place", aliases)
    return first.select("id", F.col("one.pos").alias("n"), "type", F.col("one.name").alias("name"), F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"), F.col("one.confidence").alias("confidence"))


def harvested_urls(rows: DataFrame, text: str, marker: str = r"(?i)\.m3u8|/live|/stream|playlist", longest: int = 2000, most: int = 5000) -> DataFrame:
    """(url): distinct URLs in any text that look like streams, at most `most` of them in order."""
    found = _all(F.coalesce(F.col(text), F.lit("")), r"(https?://[^\s'\"<>\\]+)")
    urls = rows.select(F.explode(found).alias("url")).where(F.col("url").rlike(marker) & (F.length("url") <= longest))
    return urls.distinct().orderBy("url").limit(most)


#: A log line's stage: the first of these of which the line, in lower case, holds a word, or all of several (fixed values).
STAGES = (
    ("source-registry", "sourcesregistry"),
    ("scope-inference", "scopeenforcementagent: requesting llm scope inference", ("scope inference", "scopeenforcementagent")),
    ("planner", "planneragent", "plan created"),
    ("planner_waiting_for_llm", "httpx.readtimeout", "httpcore.readtimeout"),
    ("search", "searchagent", "custom queries", ("search", "query")),
    ("directory-crawl", "directoryagent", "directorytraversalskill", "crawling"),
    ("feed-extraction", "extracting feeds", "feedextraction", "stream(s) found"),
    ("validation", "validationagent", "probing urls"),
    ("validation_config", "ffprobe validation disabled"),
    ("ffprobe", "running ffprobe", "validationagent ffprobe:", "ffprobe:"),
    ("visual-analysis", ("visual", "analysis")),
    ("geocoding", "llm geocoding", "geocod"),
    ("catalog-map", "catalogagent", "geojson", "mapagent", "map.html"),
    ("complete", "run-agentic complete"),
)
#: Counters that log lines carry: names, a word in lower case of every line that bears them, and the pattern of their numbers (fixed values).
METRICS = (
    (("source_registry_tier_counts", "source_registry_total_sources"), "sourcesregistry:", r"(?i)SourcesRegistry:\s*loaded tiers\s*(\{.*?\})\s*\((\d+) total sources\)"),
    (("search_progress_percent",), "searchagent custom queries:", r"SearchAgent custom queries:\s*(\d+)%"),
    (("search_queries_done", "search_queries_total"), "searchagent custom queries:", r"SearchAgent custom queries:.*?(\d+)/(\d+)"),
    (("collapsed_duplicates", "candidates_before_collapse", "candidates_after_collapse"), "collapsed", r"(?i)collapsed\s+([0-9,]+).*?\(([0-9,]+)\s*[→\-]+\s*([0-9,]+)\)"),
    (("feed_extract_percent", "feed_extract_done", "feed_extract_total"), "extracting feeds:", r"Extracting feeds:\s*(\d+)%.*?([0-9,]+)/([0-9,]+)"),
    (("validation_candidates_received",), "validationagent:", r"(?i)ValidationAgent:\s*([0-9,]+)\s+candidates received"),
    (("probe_live", "probe_dead", "probe_unknown", "probe_timeout", "probe_other"), "probe results",
     r"(?i)probe results\s+[—-]\s+live=([0-9,]+),\s*dead=([0-9,]+),\s*unknown=([0-9,]+),\s*timeout=([0-9,]+),\s*other=([0-9,]+)"),
    (("ffprobe_live", "ffprobe_unknown", "ffprobe_dead"), "ffprobe results", r"(?i)ffprobe results\s+[—-]\s+live=([0-9,]+)\s+unknown=([0-9,]+)\s+dead=([0-9,]+)"),
    (("hls_to_catalog", "catalog_live", "catalog_unknown", "catalog_dead", "catalog_dropped_dead"), "hls streams to catalog",
     r"(?i)([0-9,]+)\s+HLS streams to catalog\s+[—-]\s+live=([0-9,]+)\s+unknown=([0-9,]+)\s+dead=([0-9,]+)\s+dropped_dead=([0-9,]+)"),
    (("validated_records", "validated_with_coords", "validated_without_coords"), "validated records", r"(?i)([0-9,]+)\s+validated records\s+\(([0-9,]+)\s+with coords,\s+([0-9,]+)\s+without"),
    (("catalog_unique_after_dedup", "catalog_dropped_dedup"), "catalogagent:", r"(?i)CatalogAgent:\s*([0-9,]+)\s+unique records after dedup\s+\(dropped\s+([0-9,]+)\)"),
    (("geojson_features_written", "geojson_features_skipped"), "geojsonexportskill:", r"(?i)GeoJSONExportSkill:\s*([0-9,]+)\s+features written.*?([0-9,]+)\s+skipped"),
    (("mapped", "needs_review_location_unknown", "rejected"), "run-agentic complete", r"(?i)run-agentic complete\s+[—-]\s+mapped=([0-9,]+),\s+needs_review_location_unknown=([0-9,]+),\s+rejected=([0-9,]+)"),
)
#: Counters of a domain: candidates and pages of a crawl, streams found (fixed values).
CRAWLED = r"(?i)DirectoryTraversalSkill:\s*([0-9,]+)\s+candidates\s+from\s+([^\s]+)\s+\(([0-9,]+)\s+pages\)"
FOUND = r"(?i)([A-Za-z0-9.-]+):\s*([0-9,]+)\s+stream\(s\) found"
#: Words of URLs that look like streams, in logs (fixed values).
STREAM_WORDS = ("m3u8", "playlist", "stream", "camera", "cam")
_LINE_URLS = r"(https?://[^\s'\"<>]+)"


def line_stage(text: Column) -> Column:
    return _stage(F.lower(F.coalesce(text, F.lit(""))))


def _stage(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, *ways in reversed(STAGES):
        held = [reduce(Column.__and__, [low.contains(word) for word in ([way] if isinstance(way, str) else way)]) for way in ways]
        out = F.when(reduce(Column.__or__, held), name).otherwise(out)
    return out


def line_domain(text: Column) -> Column:
    """The authority of a line's first URL, else the name before a bracket after `from`, else what is crawled, else unknown."""
    t = F.coalesce(text, F.lit(""))
    some = lambda c: F.nullif(F.lower(c), F.lit(""))
    return F.coalesce(
        F.when(t.rlike(_LINE_URLS), F.coalesce(some(U.authority(F.regexp_extract(t, _LINE_URLS, 1))), F.lit("unknown"))),
        some(F.regexp_extract(t, r"from\s+([A-Za-z0-9.-]+)\s*\(", 1)),
        some(F.regexp_extract(t, r"crawling\s+([A-Za-z0-9.-]+)", 1)),
        F.lit("unknown"),
    )


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")  # null of an empty one


def log_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add stage, domain and one column per counter of METRICS to log lines; null where a line says nothing of it."""
    # columns of their own, so that each is worked out once a line
    lines = lines.withColumn("_short", shortened(F.coalesce(F.col(text), F.lit("")), 500)).withColumn("_low", F.lower("_short"))
    t, low = F.col("_short"), F.col("_low")
    columns = {"stage": _stage(low), "domain": line_domain(F.col(text))}
    for names, word, pattern in METRICS:
        for i, name in enumerate(names):
            value = F.when(low.contains(word), F.regexp_extract(t, pattern, i + 1))
            columns[name] = F.nullif(value, F.lit("")) if name.endswith("tier_counts") else _number(value)
    return lines.withColumns(columns).drop("_short", "_low")


def domain_metrics(lines: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """(domain, candidates, pages, streams): sums of a crawl's counts, and the last count of streams found."""
    t = shortened(F.coalesce(F.col(text), F.lit("")), 500)
    none = F.lit(None).cast("bigint")
    crawled = lines.select(
        F.lower(F.regexp_extract(t, CRAWLED, 2)).alias("domain"), _number(F.regexp_extract(t, CRAWLED, 1)).alias("candidates"), _number(F.regexp_extract(t, CRAWLED, 3)).alias("pages"),
        none.alias("streams"), F.col(order).alias("seq"),
    )
    found = lines.select(F.lower(F.regexp_extract(t, FOUND, 1)).alias("domain"), none.alias("candidates"), none.alias("pages"), _number(F.regexp_extract(t, FOUND, 2)).alias("streams"), F.col(order).alias("seq"))
    rows = crawled.unionByName(found).where(F.col("domain") != "")
    last = F.max_by("streams", F.when(F.col("streams").isNotNull(), F.col("seq")))
    return rows.groupBy("domain").agg(F.sum("candidates").alias("candidates"), F.sum("pages").alias("pages"), last.alias("streams"))


def line_urls(lines: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """(seq, pos, url, domain): every URL in log lines with its authority in lower case."""
    rows = lines.select(F.col(order).alias("seq"), F.posexplode(_all(shortened(F.coalesce(F.col(text), F.lit("")), 500), _LINE_URLS)).alias("pos", "url"))
    return rows.withColumn("domain", F.coalesce(F.nullif(F.lower(U.authority(F.col("url"))), F.lit("")), F.lit("unknown")))


def url_domains(lines: DataFrame, text: str = "text", order: str = "seq", recent: int = 25) -> tuple[DataFrame, DataFrame]:
    """((domain, n), (seq, pos, url)): how often each domain turns up, and the last `recent` URLs that look like streams."""
    urls = line_urls(lines, text, order)
    streams = urls.where(F.lower("url").rlike("|".join(STREAM_WORDS))).select("seq", "pos", F.substring("url", 1, 500).alias("url"))
    return urls.groupBy("domain").agg(F.count("*").alias("n")), streams.orderBy(F.desc("seq"), F.desc("pos")).limit(recent)
