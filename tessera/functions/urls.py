"""URL expressions. All are Column -> Column over built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visitor (fixed values).
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "msclkid",
    "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "twclid",
)
#: A leading language segment of a path (fixed value).
LANGUAGE_PREFIX = r"^/[a-z]{2}(?:[_-][a-zA-Z]{2,4})?/"
STREAM_PATTERN = r"(?i)\.m3u8(\?|$)"
AUTH_PATTERN = r"(?i)/(login|signin|sign-in|auth|register|subscribe|account|member|join)"

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    """User, host and port as written; empty without `//`."""
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 5)


def domain(url: Column) -> Column:
    """Authority without a leading `www.`."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def decoded(text: Column, plus: bool = False) -> Column:
    """Percent-decoding that leaves malformed input as it is; `plus` also turns + into a space."""
    escaped = text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(escaped), text)


def query_pairs(url: Column) -> Column:
    """ARRAY<STRUCT<k, v>> in order, decoded, repeats kept, blank values kept."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1), True).alias("k"),
            decoded(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise(""), True).alias("v"),
        ),
    )


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _assembled(scheme_: Column, authority_: Column, path_: Column, query_: Column) -> Column:
    start = F.when(authority_ != "", F.concat(scheme_, F.lit("://"), authority_)).otherwise(F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""))
    return F.concat(start, path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))


def catalogue_key(url: Column, tracking: Sequence[str] = TRACKING_PARAMS) -> Column:
    """One key for spellings of a URL in the catalogue.

    https always; a leading `www.` goes (in lower case only); tracking parameters go; of a repeated
    parameter the first value stays, parameters are sorted; trailing slashes and the fragment go; all
    in lower case.
    """
    kept = F.filter(query_pairs(url), lambda p: ~F.lower(p["k"]).isin(*tracking))
    names = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["k"])))
    first = F.transform(names, lambda n: F.get(F.filter(kept, lambda p: p["k"] == n), F.lit(0)))
    return F.lower(_assembled(F.lit("https"), domain(url), F.regexp_replace(path(url), "/+$", ""), _joined(first)))


def gate_key(url: Column) -> Column:
    """One key for spellings of a search result: utm parameters go, order and repeats stay, only scheme and authority in lower case."""
    raw = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"\s+", " "))
    kept = F.filter(query_pairs(raw), lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")))
    bare = F.regexp_replace(F.regexp_replace(path(raw), r";[^/]*$", ""), "/+$", "")
    out = _assembled(scheme(raw), F.lower(authority(raw)), F.when(bare == "", "/").otherwise(bare), _joined(kept))
    return F.when(raw == "", "").otherwise(out)


def language_neutral_key(url: Column) -> Column:
    """Authority, path without one leading language segment, and query."""
    bare = F.regexp_replace(path(url), LANGUAGE_PREFIX, "/")
    return F.concat(authority(url), bare, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def unwrapped(url: Column, stream: str = ".m3u8") -> Column:
    """The stream URL inside a player's URL: a query value that starts with http and holds `stream`, else a match in the decoded whole."""
    inner = F.get(
        F.filter(F.transform(query_pairs(url), lambda p: decoded(p["v"])), lambda v: F.startswith(F.lower(v), F.lit("http")) & F.contains(F.lower(v), F.lit(stream))),
        F.lit(0),
    )
    whole = decoded(F.substring(url, 9, 1 << 20))
    nested = F.nullif(F.regexp_extract(whole, rf"(?i)(https?://.+?{_quoted(stream)}[^\s'\"]*)", 1), F.lit(""))
    return F.coalesce(inner, nested, url)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def resolved(link: Column, base: Column) -> Column:
    """A link made absolute (RFC 3986): with a scheme, protocol-relative, root-relative or relative, dot segments removed."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.when(F.startswith(link, F.lit("/")), path(link)).otherwise(F.concat(folder, path(link)))
    whole = F.when(path(link) == "", path(base)).otherwise(without_dots(joined))
    tail = F.concat(
        F.when(F.contains(link, F.lit("?")), F.concat(F.lit("?"), query(link))).when((path(link) == "") & (query(base) != ""), F.concat(F.lit("?"), query(base))).otherwise(""),
        F.when(F.contains(link, F.lit("#")), F.concat(F.lit("#"), fragment(link))).otherwise(""),
    )
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .otherwise(F.concat(origin, whole, tail))
    )


def without_dots(path_: Column) -> Column:
    """Remove . and .. segments of an absolute path."""
    parts = F.split(path_, "/")
    walked = F.aggregate(
        F.slice(parts, 2, 1 << 20),
        F.array().cast("array<string>"),
        lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)),
    )
    ends_open = path_.rlike(r"/\.{1,2}$")
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends_open & (F.size(walked) > 0), "/").otherwise(""))


def normalised_link(raw: Column, base: Column, stream: str = ".m3u8") -> Column:
    """A link found in a page: trimmed, quotes off, unwrapped, `\\/` unescaped, made absolute."""
    bare = F.regexp_replace(F.trim(raw), r"^['\"]+|['\"]+$", "")
    return resolved(F.replace(unwrapped(bare, stream), F.lit("\\/"), F.lit("/")), base)


def is_stream(url: Column, variant: str = "direct") -> Column:
    """`direct`: http(s) and ends (or has its query) after .m3u8; `loose`: holds it; `browser`: a slash may follow as well."""
    if variant == "loose":
        return F.contains(F.lower(url), F.lit(".m3u8"))
    if variant == "browser":
        return url.rlike(r"(?i)\.m3u8([?/]|$)")
    return url.rlike(STREAM_PATTERN) & url.rlike("(?i)^https?://")


def reject_reason(url: Column, wanted: str = STREAM_PATTERN) -> Column:
    """Why a URL isn't worth a probe: missing_protocol, auth_url_pattern (in the path), not_hls; null if it is."""
    clean = unwrapped(url)
    return (
        F.when(~clean.rlike("(?i)^https?://"), "missing_protocol")
        .when(path(clean).rlike(AUTH_PATTERN), "auth_url_pattern")
        .when(~clean.rlike(wanted), "not_hls")
    )


#: Format buckets in the order of their reports (fixed values).
FORMAT_BUCKETS = (".m3u8", "RTSP", "MJPEG", "MP4-only", "JPEG-refresh", "DASH", "YouTube-only source", "Other/HTML/unknown")


def format_bucket(url: Column) -> Column:
    """Media bucket that a URL's spelling tells."""
    low = F.lower(url)

    def ext(*names: str) -> Column:
        return low.rlike(r"\.(" + "|".join(names) + r")($|\?)")

    return (
        F.when(scheme(url).isin("rtsp", "rtsps"), "RTSP")
        .when(ext("m3u8"), ".m3u8")
        .when(ext("mpd") | F.contains(low, F.lit("/dash/")), "DASH")
        .when(authority(low).rlike(r"youtube\.com|youtu\.be"), "YouTube-only source")
        .when(low.rlike(r"mjpeg|\.mjpg|multipart/x-mixed-replace"), "MJPEG")
        .when(ext("mp4"), "MP4-only")
        .when(ext("jpe?g") | low.rlike("snapshot|refresh"), "JPEG-refresh")
        .otherwise("Other/HTML/unknown")
    )


def observed_bucket(url: Column, content_type: Column, body: Column) -> Column:
    """format_bucket(), and where that tells nothing what a probe saw: content type, first bytes, links in the page."""
    kind, head, page = F.lower(F.coalesce(content_type, F.lit(""))), F.upper(F.substring(body, 1, 8192)), F.substring(body, 1, 65536)

    def linked(extension: str) -> Column:
        return page.rlike(rf"(?i)['\"][^'\"]{{4,500}}\.{extension}[^'\"]{{0,100}}['\"]")

    seen = (
        F.when(kind.rlike(r"application/(vnd\.apple|x-)\.?mpegurl"), ".m3u8")
        .when(F.contains(kind, F.lit("application/dash+xml")), "DASH")
        .when(kind.rlike("multipart/x-mixed-replace|mjpeg"), "MJPEG")
        .when(F.startswith(kind, F.lit("video/mp4")), "MP4-only")
        .when(F.startswith(kind, F.lit("image/jpeg")), "JPEG-refresh")
        .when(F.contains(head, F.lit("#EXTM3U")), ".m3u8")
        .when(F.contains(head, F.lit("<MPD")), "DASH")
        .when(linked("m3u8"), ".m3u8")
        .when(page.rlike(r"(?i)['\"]rtsps?://[^'\"]{4,400}['\"]"), "RTSP")
        .when(page.rlike(r"(?i)multipart/x-mixed-replace|\.mjpe?g['\"?]"), "MJPEG")
        .when(linked("mpd"), "DASH")
        .when(linked("mp4"), "MP4-only")
        .when(page.rlike("(?i)snapshot|getimage"), "JPEG-refresh")
    )
    first = format_bucket(url)
    return F.when(first != "Other/HTML/unknown", first).otherwise(F.coalesce(seen, first))


def url_type(url: Column) -> Column:
    """Report class of a URL; what has no http protocol is told apart only after the media classes."""
    return (
        F.when(url.rlike(STREAM_PATTERN), "hls-stream")
        .when(url.rlike(r"(?i)\.(mp4|webm|ogv)(\?|$)"), "mp4-file")
        .when(url.rlike(r"(?i)youtube(?:-nocookie)?\.com/embed/"), "youtube-embed")
        .when(url.rlike(r"(?i)/embed[/?]|embed\."), "embed-page")
        .when(~url.rlike("(?i)^https?://"), "invalid-protocol")
        .otherwise("html-page")
    )


#: Paths of listings, words of marketing pages, and segments of collections and of single items (fixed values).
LISTING_PATH = r"(?i)/(?:tag|tags|category|categories|search|sitemap|feed|rss)(?:/|$|\?|\.)"
SHALLOW_TOKENS = (
    "about", "advertise", "advertising", "brand", "brands", "contact", "docs", "faq", "help", "leaflets", "partner", "partners",
    "pricing", "privacy", "resource", "resources", "support", "terms",
)
COLLECTION_SEGMENTS = ("cameras", "collections", "galleries", "livecams", "streams", "webcams")
DETAIL_SEGMENTS = ("cam", "camera", "livecam", "player", "stream", "view", "webcam")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def segments(path_: Column) -> Column:
    return F.filter(F.split(path_, "/"), lambda s: s != "")


def is_listing_page(url: Column) -> Column:
    """Whether a page can't be about one item: a listing, a shallow marketing page, or a collection's own page below which nothing is named."""
    parts = F.transform(segments(path(url)), F.lower)
    words = F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(p, r"\.[^.]*$", ""), "[-_]")))
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    shallow = (F.size(parts) <= 2) & F.arrays_overlap(words, _texts(SHALLOW_TOKENS))
    collection = F.arrays_overlap(inner, _texts(COLLECTION_SEGMENTS)) & ~F.arrays_overlap(parts, _texts(DETAIL_SEGMENTS))
    return path(url).rlike(LISTING_PATH) | shallow | collection


def path_depth(url: Column) -> Column:
    return F.size(segments(path(url)))


#: Path segments of languages and of a site's structure, which name no place (fixed values).
LANGUAGE_SEGMENTS = (
    "en", "it", "fr", "de", "es", "pt", "ru", "zh", "ja", "ko", "nl", "pl", "sv", "tr", "ar", "cs", "da", "fi", "hu", "nb", "ro", "sk",
    "uk", "el", "zh-cn", "zh-tw", "pt-br", "en-us", "en-gb", "en-au",
)
STRUCTURE_SEGMENTS = (
    "webcam", "webcams", "cam", "cams", "camera", "cameras", "live", "stream", "streaming", "video", "watch", "view", "views", "feed",
    "world", "global",
)


def title_case(text: Column) -> Column:
    """Upper case after every character that isn't a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def geo_hierarchy(url: Column) -> Column:
    """STRUCT<country, region, city> that a page's path names: three or more parts, two, or one."""
    parts = segments(path(url))
    parts = F.when(F.lower(F.get(parts, F.lit(0))).isin(*LANGUAGE_SEGMENTS), F.slice(parts, 2, 1 << 20)).otherwise(parts)
    parts = F.filter(parts, lambda p: ~F.lower(p).isin(*STRUCTURE_SEGMENTS))
    leaf = (F.size(parts) >= 4) | F.coalesce(F.get(parts, F.size(parts) - 1).rlike(r"\.[a-zA-Z0-9]{2,5}$"), F.lit(False))
    parts = F.when(leaf & (F.size(parts) > 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    places = F.transform(parts, lambda p: title_case(F.translate(F.regexp_replace(p, r"\.[^./]+$", ""), "-_", "  ")))
    n, at = F.size(places), lambda i: F.get(places, F.lit(i))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(n >= 2, at(0)).otherwise(none).alias("country"),
        F.when(n >= 3, at(1)).otherwise(none).alias("region"),
        F.when(n >= 3, F.get(places, n - 1)).when(n == 2, at(1)).when(n == 1, at(0)).otherwise(none).alias("city"),
    )
