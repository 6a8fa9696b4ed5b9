"""Gates and scores: which candidates go on, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators.contains import TERMS, Terms, lists
from tessera.storage import stored

#: Test hosts, patterns of archives and demos, and regions off target (fixed values).
BLOCKED_TEST_DOMAINS = ("test-streams.mux.dev", "bitdash-a.akamaihd.net", "demo.unified-streaming.com", "gist.github.com", "github.com", "m3u8-player.com")
BLOCKED_PATTERNS = ("vod", "archive", "archives", "backup.mp4", "newyears", "bigbuckbunny", "sample", "demo", "test-stream", "iptv", "ip.aa.dd.rr")
OFF_TARGET_TOKENS = ("maryland", "michigan", "newyork", "new-york", "virginia", "ohio", "florida", "texas", "california")
CAMERA_TERMS = ("camera", "webcam", "traffic", "hls", "m3u8")
CDN_HOSTS = ("cloudfront.net", "akamaihd.net", "fastly.net")
#: Words of search results (fixed values).
POSITIVE = ("camera", "cctv", "traffic", "webcam", "stream", "live", "map", "region", "511", "dot", "turnpike")
NEGATIVE = ("privacy", "terms", "careers", "login", "signup", "press", "blog", "news", "pdf", "job")
#: Phrases of pages whose stream is off (fixed values).
OFFLINE_MARKERS = (
    "camera offline", "camera unavailable", "camera is offline", "stream unavailable", "stream offline", "no signal", "temporarily unavailable",
    "currently unavailable", "webcam offline", "webcam unavailable", "not available",
)
WEAK_REASONS = (
    "no source-page target evidence", "query-only target evidence", "missing camera/hls evidence", "untrusted cdn without strong lineage",
    "insufficient target evidence", "weak target evidence",
)
LATE_STAGES = ("validation", "robots", "policy", "malformed_url", "non_hls")
LEGITIMACY = ("low", "medium", "high")
#: Terms of a request that are looked for one by one.
FEW = 32


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values if v]) if any(values) else F.array().cast("array<string>")


def _any_of(words: Sequence[str]) -> str:
    return "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in w) for w in words)


def blob(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns]))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """ARRAY of the terms that occur in a text, in lower case; terms are a list of the request. More than FEW are looked for in one walk."""
    wanted = list(dict.fromkeys(v.lower() for v in terms if v))
    if len(wanted) <= FEW:
        return F.filter(_list(terms), lambda t: F.contains(text, t))
    return F.array_intersect(_list(wanted), Terms(SparkSession.active(), wanted).found(text))


def word_hits(text: Column, terms: Sequence[str]) -> Column:
    """Like term_hits(), but a single word counts only between characters that aren't letters or digits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for t in sorted({t.strip().lower() for t in terms if t and t.strip()}):
        found = F.contains(low, F.lit(t)) if " " in t else low.rlike(rf"(^|[^a-z0-9])(?:{_any_of([t])})($|[^a-z0-9])")
        hits.append(F.when(found, F.lit(t)))
    return F.filter(F.array(*hits), lambda t: t.isNotNull()) if hits else F.array().cast("array<string>")


def legitimacy_ok(score: Column, status: Column, minimum: str, frames_checked: bool = False) -> Column:
    """Whether a score reaches the minimum; an unknown status needs minimum low; with frame checks all pass."""
    if frames_checked:
        return F.lit(True)
    ranks = F.array(*[F.lit(x) for x in LEGITIMACY])
    enough = F.array_position(ranks, score) >= LEGITIMACY.index(minimum) + 1
    return F.when(status == "unknown", F.lit(minimum == "low")).otherwise(F.coalesce(enough, F.lit(False)))


def in_bbox(lon: Column, lat: Column, bbox: Sequence[float] | None) -> Column:
    """Null without a box, false for what isn't a number; bounds (west, south, east, north) count."""
    if bbox is None:
        return F.lit(None).cast("boolean")
    west, south, east, north = bbox
    x, y = lon.try_cast("double"), lat.try_cast("double")
    return F.coalesce(x.between(west, east) & y.between(south, north), F.lit(False))


def split_by_location(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with coordinates, and those to review."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return records.where(located), records.where(~located)


def facets(records: DataFrame, text: str | None = None, most: int | None = 100, order: Sequence[str] = ("id",), **chosen: Sequence[str]) -> DataFrame:
    """Records of the chosen values of columns, and with text in city, label, country or continent; the first `most` shown."""
    out = records
    for column, values in chosen.items():
        if values:
            out = out.where(F.col(column).isin(*values))
    if text:
        out = out.where(F.contains(blob("city", "label", "country", "continent"), F.lit(text.lower())))
    return out.orderBy(*order).limit(most) if most else out


def offline_flag(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(_any_of(OFFLINE_MARKERS)), F.lit(False))


def weak_rejections(decisions: DataFrame, reason: str = "reason", stage: str = "stage") -> DataFrame:
    """Rejections on weak evidence before any probe."""
    low = F.lower(F.coalesce(F.col(stage), F.lit("")))
    return decisions.where(F.lower(F.coalesce(F.col(reason), F.lit(""))).rlike(_any_of(WEAK_REASONS)) & ~low.isin(*LATE_STAGES))


def feed_type(playlist_type: Column, url: Column, content_type: Column) -> Column:
    hinted = url.rlike(U.STREAM_PATTERN) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("mpegurl"))
    return F.when(playlist_type == "master", "HLS_master").when(playlist_type == "media", "HLS_stream").when(F.coalesce(hinted, F.lit(False)), "HLS_stream").otherwise("unknown")


def decision_gaps(decisions: DataFrame, stage: str = "stage") -> DataFrame:
    """Per stage: decisions, those without reason or confidence, those without provider, model or raw answer."""

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c).cast("string") == "")

    return decisions.groupBy(stage).agg(
        F.count("*").alias("decisions"),
        F.count_if(blank("reason") | blank("confidence")).alias("without_reason"),
        F.count_if(blank("provider") | blank("model") | blank("raw")).alias("without_provenance"),
    )


def priorities(candidates: DataFrame, locations: Sequence[str] = (), agencies: Sequence[str] = (), camera_types: Sequence[str] = (), text: Sequence[str] = ("candidate_url", "source_page", "root_url", "source_query")) -> DataFrame:
    """Add priority, priority_score, priority_reason, sent_to_validation and evidence."""
    words = blob(*text)
    url = F.coalesce(F.col("candidate_url"), F.lit(""))
    target, camera = F.size(term_hits(words, [*locations, *agencies])), F.size(term_hits(words, [*camera_types, *CAMERA_TERMS]))
    malformed = ~url.rlike("^https?://")
    blocked = F.lower(U.authority(url)).isin(*BLOCKED_TEST_DOMAINS)
    relevance = F.coalesce(F.col("page_relevance_score"), F.lit(0.0))
    score = F.lit(0.2) + F.least(F.lit(0.5), 0.2 * target) + F.least(F.lit(0.2), 0.1 * camera) + F.when(F.contains(F.lower(url), F.lit(".m3u8")), 0.2).otherwise(0.0) + F.least(F.lit(0.1), relevance * 0.1)
    stopped = malformed | blocked

    def some(c: str) -> Column:
        return F.when(~stopped & (F.coalesce(F.col(c), F.lit("")) != ""), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    evidence = F.create_map(
        F.lit("url_evidence"), F.array(F.when(~malformed & blocked, F.lower(U.authority(url))).otherwise(url)),
        F.lit("feed_metadata_evidence"), none, F.lit("source_page_evidence"), some("source_page"), F.lit("query_evidence"), some("source_query"), F.lit("visual_evidence"), none,
    )
    return candidates.withColumns(
        {
            "priority": F.when(stopped, "low").when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low"),
            "priority_score": F.when(stopped, 0.0).otherwise(F.round(score, 4)),
            "priority_reason": F.when(malformed, "malformed_url").when(blocked, "policy_blocked_test_domain").otherwise("prioritized_for_validation"),
            "sent_to_validation": ~stopped,
            "evidence": evidence,
        }
    )


def relevance(candidates: DataFrame, locations: Sequence[str] = (), agencies: Sequence[str] = (), camera_types: Sequence[str] = ()) -> DataFrame:
    """Add accepted, relevance_score and reason: the first rule of seven that rejects a candidate, or acceptance."""
    targets = [*locations, *agencies]
    host = F.lower(U.authority(F.col("candidate_url")))
    page = F.when(F.col("source_page").rlike("^https?://"), F.col("source_page"))
    lineage = F.lower(F.concat_ws(" ", "candidate_url", page, "root_url"))
    hits = F.size(term_hits(lineage, targets))
    in_query = F.size(term_hits(F.lower(F.coalesce("source_query", F.lit(""))), targets)) > 0
    elsewhere = [t for t in OFF_TARGET_TOKENS if not any(t in x.lower() for x in targets)]
    pattern = F.get(term_hits(lineage, BLOCKED_PATTERNS), F.lit(0))
    strong = page.isNotNull() & ((F.coalesce("page_relevance_score", F.lit(0.0)) >= 0.6) | (F.coalesce("camera_likelihood_score", F.lit(0.0)) >= 0.6))
    cdn = F.lit(False)
    for h in CDN_HOSTS:
        cdn = cdn | F.endswith(host, F.lit(h))
    reason = (
        F.when(host.isin(*BLOCKED_TEST_DOMAINS), "rejected: generic demo/test domain")
        .when(pattern.isNotNull(), F.concat(F.lit("rejected: blocked pattern '"), pattern, F.lit("'")))
        .when((hits == 0) & in_query, "rejected: query-only target evidence")
        .when((hits == 0) & (F.size(term_hits(lineage, elsewhere)) > 0), "rejected: off_target_region_or_agency")
        .when(hits == 0, "rejected: no source-page target evidence")
        .when(F.size(term_hits(lineage, [*camera_types, *CAMERA_TERMS])) == 0, "rejected: missing camera/hls evidence")
        .when(cdn & ~strong, "rejected: untrusted CDN without strong lineage")
        .otherwise("accepted: source lineage + target evidence")
    )
    out = candidates.withColumn("reason", reason)
    accepted = F.startswith("reason", F.lit("accepted"))
    return out.withColumns({"accepted": accepted, "relevance_score": F.when(accepted, 0.9).otherwise(0.1)})


def triage(pages: DataFrame, terms: Sequence[str] = (), text: Sequence[str] = ("url", "title", "snippet", "source_query")) -> DataFrame:
    """Add page_type, relevance_score, camera_likelihood_score, requires_deep_dive, strategies and max_depth of search results."""
    words = blob(*text)
    pos, neg, loc = (F.size(term_hits(words, t)) for t in (POSITIVE, NEGATIVE, terms))
    camera = F.least(F.lit(1.0), 0.15 * pos - 0.2 * neg + F.when(loc > 0, 0.15).otherwise(0.0))
    relevant = F.least(F.lit(1.0), 0.2 * pos - 0.2 * neg + 0.2 * F.least(loc, F.lit(2)))
    kind = (
        F.when(F.contains(words, F.lit("m3u8")), "direct_hls_stream")
        .when(F.contains(words, F.lit("region")), "camera_region_page")
        .when(words.rlike("cctv|camera ?listing|webmap"), "camera_listing_or_map")
        .when(words.rlike("player|viewer"), "player_page")
        .otherwise("generic_search_result")
    )
    out = pages.withColumns({"page_type": kind, "relevance_score": F.round(relevant, 6), "camera_likelihood_score": F.round(camera, 6)})
    deep = (F.col("relevance_score") >= 0.4) & (F.col("camera_likelihood_score") >= 0.35) & (F.col("page_type") != "direct_hls_stream")
    scripted = F.col("page_type").isin("camera_listing_or_map", "camera_region_page", "player_page")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "requires_deep_dive": deep,
            "likely_requires_js": scripted,
            "strategies": F.concat(
                F.when(deep, F.array(F.lit("static_html"), F.lit("iframe_follow"), F.lit("same_domain_links"))).otherwise(none),
                F.when(scripted, F.array(F.lit("javascript_asset_scan"), F.lit("network_capture"))).otherwise(none),
            ),
            "max_depth": F.when(F.col("page_type") == "camera_listing_or_map", 3).when(deep, 2).otherwise(0),
        }
    )


def domain_suffixes(domain: Column) -> Column:
    """a.b.c gives a.b.c, b.c, c: what a rule for it or a parent could be."""
    parts = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def without_blocked(rows: DataFrame, blocked: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Rows whose domain is neither blocked nor below a blocked one. An equi-join on exploded suffixes, not a nested loop."""
    hosts = rows.select(U.domain(F.col(url)).alias("_host")).distinct()
    hit = hosts.select("_host", F.explode(domain_suffixes(F.col("_host"))).alias("_suffix"))
    bad = hit.join(blocked.select(F.lower(domain).alias("_suffix")), "_suffix", "left_semi").select("_host").distinct()
    return rows.withColumn("_host", U.domain(F.col(url))).join(bad, "_host", "left_anti").drop("_host")


def normal_text(text: Column) -> Column:
    """Lower case, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\W_]+", " "))


def without_rules(rows: DataFrame, rules: DataFrame, fields: Sequence[str], most: int = TERMS) -> DataFrame:
    """Rows that no rule (field, term) blocks: a term of its field, or of any field if the rule's field is null.

    Each field is walked over once for each list of `most` terms that concern it, see contains.Terms; rows stay where they are.
    """
    terms = stored(rules.select("field", normal_text(F.col("term")).alias("_term")), "rules")
    blocked = F.lit(False)
    for f in fields:
        for part in lists(terms.where(F.col("field").isNull() | (F.col("field") == f)), "_term", most):
            blocked |= part.any(normal_text(F.col(f)))
    return rows.where(~blocked)


#: Paths whose permission decides for a domain (fixed values).
ROBOTS_PATHS = ("/webcam", "/webcams", "/camera", "/cameras", "/live", "/stream", "/cam")


def robots_policies(robots: DataFrame, agent: str = "*", paths: Sequence[str] = ROBOTS_PATHS) -> DataFrame:
    """(domain, allowed, disallowed): per domain whether all paths may be fetched by any agent, and its disallow lines.

    Of the rules for `*` the first in file order whose path is a prefix decides; an empty disallow allows;
    no file or another status than 200 allows. disallowed lists those of `*` and of `agent`.
    """
    lines = robots.where(F.col("status_code") == 200).select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("domain", "pos", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("key"), F.trim(F.regexp_replace(bare, "^[^:]*:?", "")).alias("value"))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow"))
    # a block is a run of agent lines and the rules below it; robots files are small, so a domain is a small window
    order = Window.partitionBy("domain").orderBy("pos")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    agents = lines.where(F.col("key") == "user-agent").select("domain", "block", F.lower("value").alias("agent")).distinct()
    rules = lines.where(F.col("key") != "user-agent").join(agents, ["domain", "block"])
    tests = F.explode(F.array(*[F.lit(p) for p in paths])).alias("path")
    hits = rules.where(F.col("agent") == "*").select("domain", "pos", "key", "value", tests).where((F.col("value") == "") | F.startswith("path", F.col("value")))
    verdict = hits.groupBy("domain", "path").agg(F.min_by(F.struct("key", "value"), "pos").alias("r"))
    denied = verdict.groupBy("domain").agg(F.bool_or((F.col("r.key") == "disallow") & (F.col("r.value") != "")).alias("denied"))
    wanted = {"*", agent.lower()}
    listed = rules.where(F.col("agent").isin(*wanted) & (F.col("key") == "disallow") & (F.col("value") != "")).groupBy("domain").agg(F.array_sort(F.collect_set("value")).alias("disallowed"))
    out = robots.select("domain").distinct().join(denied, "domain", "left").join(listed, "domain", "left")
    return out.select("domain", (~F.coalesce("denied", F.lit(False))).alias("allowed"), F.coalesce("disallowed", F.array().cast("array<string>")).alias("disallowed"))


def robots_gate(candidates: DataFrame, policies: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose domain isn't denied; a domain without a policy is allowed."""
    denied = policies.where(~F.col("allowed")).select(F.col("domain").alias("_domain"))
    return candidates.withColumn("_domain", U.domain(F.col(url))).join(denied, "_domain", "left_anti").drop("_domain")


def http_status(code: Column, is_stream: Column) -> Column:
    """STRUCT<status, fail_reason> of a check by its HTTP status; null is a timeout."""
    return (
        F.when(~is_stream, F.struct(F.lit("dead").alias("status"), F.lit("not_hls").alias("fail_reason")))
        .when(code.isNull(), F.struct(F.lit("unknown").alias("status"), F.lit("timeout").alias("fail_reason")))
        .when(code.between(200, 206), F.struct(F.lit("live").alias("status"), F.lit(None).cast("string").alias("fail_reason")))
        .when(code.isin(301, 302), F.struct(F.lit("unknown").alias("status"), F.concat(F.lit("http_"), code.cast("string")).alias("fail_reason")))
        .when(code.isin(401, 403, 407), F.struct(F.lit("dead").alias("status"), F.lit("auth_required").alias("fail_reason")))
        .otherwise(F.struct(F.lit("dead").alias("status"), F.concat(F.lit("http_"), code.cast("string")).alias("fail_reason")))
    )


def probe_verdict(code: Column, content_type: Column, body: Column) -> Column:
    """STRUCT<status, legitimacy_score, fail_reason, playlist_type> of a probe by status, content type and first bytes."""
    magic = F.startswith(F.ltrim(F.coalesce(body, F.lit(""))), F.lit("#EXTM3U"))
    typed = F.lower(F.coalesce(content_type, F.lit(""))).rlike(r"application/(x-mpegurl|vnd\.apple\.mpegurl)")
    ok = F.coalesce(code.between(200, 206), F.lit(False))
    master = F.contains(body, F.lit("#EXT-X-STREAM-INF"))
    none = F.lit(None).cast("string")

    def verdict(status: str, score: str, reason: Column, kind: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(score).alias("legitimacy_score"), reason.alias("fail_reason"), kind.alias("playlist_type"))

    return (
        F.when(code.isNull(), verdict("unknown", "low", F.lit("timeout"), none))
        .when(~ok, verdict("dead", "low", F.concat(F.lit("http_"), code.cast("string")), none))
        .when(magic, verdict("live", "high", none, F.when(master, "master").otherwise("media")))
        .when(typed, verdict("live", "medium", none, none))
        .otherwise(verdict("unknown", "low", F.lit("no_magic"), none))
    )
