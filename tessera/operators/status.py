"""Status: fold probe, stream-map, frame and playlist observations into one verdict per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.operators.gates import legitimacy_ok


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; map-side combined, so a hot key costs one row per task."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in others])


def with_probe(candidates: DataFrame, probes: DataFrame, order: str = "probed_at") -> DataFrame:
    """Candidates with the last probe of their URL; those never probed go."""
    return candidates.join(latest(probes, "url", order), "url")


def stream_map_upgrade(rows: DataFrame, probes: DataFrame, stream_map: DataFrame, offline: DataFrame) -> DataFrame:
    """A page whose mapped stream is live takes the stream's verdict; an offline page is dead.

    rows have url, status, legitimacy_score, fail_reason; stream_map (page_url, stream_url), offline (page_url).
    Of several live streams of a page the least URL counts.
    """
    live = probes.where(F.col("status") == "live").select(F.col("url").alias("stream_url"), F.col("legitimacy_score").alias("_score"))
    best = stream_map.join(live, "stream_url").groupBy(F.col("page_url").alias("url")).agg(F.min(F.struct("stream_url", "_score")).alias("_up"))
    off = offline.select(F.col("page_url").alias("url"), F.lit(True).alias("_off")).distinct()
    out = rows.join(best, "url", "left").join(off, "url", "left")
    up, down = F.col("_up").isNotNull(), F.coalesce("_off", F.lit(False))
    return out.withColumns(
        {
            "status": F.when(down, "dead").when(up, "live").otherwise(F.col("status")),
            "legitimacy_score": F.when(up & ~down, F.col("_up._score")).otherwise(F.col("legitimacy_score")),
            "fail_reason": F.when(down, "browser_offline_marker").when(~up, F.col("fail_reason")),
            "stream_url": F.when(up & ~down, F.col("_up.stream_url")),
        }
    ).drop("_up", "_off")


def frame_override(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """A frame verdict (url, frame_status, detail) replaces the status, unless it is null; live clears the reason."""
    out = rows.join(frames.select("url", "frame_status", "detail"), "url", "left")
    status = F.coalesce("frame_status", "status")
    reason = F.when(status == "live", F.lit(None).cast("string")).when(F.col("frame_status").isNotNull(), F.col("detail")).otherwise(F.col("fail_reason"))
    return out.withColumns({"fail_reason": reason, "status": status}).drop("frame_status", "detail")


def playlist_override(rows: DataFrame, playlists: DataFrame) -> DataFrame:
    """A live row whose playlist isn't a live one is unknown, for that reason."""
    out = rows.join(playlists.select("url", "classification"), "url", "left")
    off = (F.col("status") == "live") & F.col("classification").isNotNull() & (F.col("classification") != "live_playlist")
    return out.withColumns(
        {"fail_reason": F.when(off, F.concat(F.lit("playlist:"), "classification")).otherwise(F.col("fail_reason")), "status": F.when(off, "unknown").otherwise(F.col("status"))}
    ).drop("classification")


def resolve(candidates: DataFrame, probes: DataFrame, stream_map: DataFrame, offline: DataFrame, frames: DataFrame | None, playlists: DataFrame, minimum: str = "medium") -> DataFrame:
    """The whole chain: probe, stream map, frames, playlists; the dead go, then what isn't legitimate enough."""
    rows = stream_map_upgrade(with_probe(candidates, probes), probes, stream_map, offline)
    if frames is not None:
        rows = frame_override(rows, frames)
    rows = playlist_override(rows, playlists)
    return rows.where(F.col("status") != "dead").where(legitimacy_ok(F.col("legitimacy_score"), F.col("status"), minimum, frames is not None))


def frame_metrics(frames: DataFrame) -> DataFrame:
    """(url, frame_no, mean, std, dark_share, entropy, n) of pixel arrays, by built-in array functions in one pass.

    A frame without pixels is dark and has no entropy.
    """
    p, runs, ends = F.col("pixels"), F.col("_runs"), F.col("_ends")
    n = F.size(p)
    total = F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x)
    squares = F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)
    # counts of equal values are the gaps between ends of runs in the sorted pixels; each step is a column
    # of its own, else the sort would be done again for every element
    frames = frames.withColumn("_runs", F.array_sort(p))
    last_of_run = F.transform(runs, lambda x, i: F.when((i == n - 1) | (F.get(runs, i + 1) != x), i + 1))
    frames = frames.withColumn("_ends", F.filter(last_of_run, lambda e: e.isNotNull()))
    frames = frames.withColumn("_counts", F.transform(ends, lambda e, i: e - F.coalesce(F.get(ends, i - 1), F.lit(0))))
    entropy = F.aggregate("_counts", F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))
    some = n > 0
    mean = total / n
    return frames.select(
        "url",
        "frame_no",
        F.when(some, mean).otherwise(0.0).alias("mean"),
        F.when(some, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))).otherwise(0.0).alias("std"),
        F.when(some, F.size(F.filter(p, lambda x: x < 12)) / n).otherwise(1.0).alias("dark_share"),
        F.when(some, entropy).otherwise(0.0).alias("entropy"),
        F.when(some, F.size(F.filter(p, lambda x: x < 8))).otherwise(0).alias("near_black"),
        F.greatest(n, F.lit(0)).alias("n"),
    )


def frame_differences(frames: DataFrame) -> DataFrame:
    """(url, frame_no, diff): mean absolute difference to the frame before, over the length both have."""
    rows = scan.lagged(frames, ["url"], ["frame_no"], F.col("pixels"), "_before").withColumn("_before", F.col("_before.v")).where(F.col("_before").isNotNull())
    n = F.least(F.size("pixels"), F.size("_before"))
    gaps = F.zip_with(F.slice("pixels", 1, F.greatest(n, F.lit(1))), F.slice("_before", 1, F.greatest(n, F.lit(1))), lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return rows.where(n > 0).select("url", "frame_no", (total / n).alias("diff"))


def frame_summary(frames: DataFrame) -> DataFrame:
    """(url, frames, blank_frames, brightness, entropy, max_diff, mean_diff, still_share, near_black_share)."""
    stats = frame_metrics(frames)
    blank = (F.col("dark_share") > 0.90) & (F.col("std") < 8.0) & (F.col("entropy") < 2.0)
    per = stats.groupBy("url").agg(
        F.count("*").alias("frames"),
        F.count_if(blank).alias("blank_frames"),
        F.avg("mean").alias("brightness"),
        F.avg("entropy").alias("entropy"),
        (F.sum("near_black") / F.sum("n")).alias("near_black_share"),
    )
    diffs = frame_differences(frames).groupBy("url").agg(
        F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"), F.avg(F.when(F.col("diff") < 1.2, 1.0).otherwise(0.0)).alias("still_share")
    )
    return per.join(diffs, "url", "left")


def frame_verdicts(frames: DataFrame) -> DataFrame:
    """(url, frame_status, detail): blank before frozen, both unknown; null if no frame has pixels."""
    s = frame_summary(frames.where(F.size("pixels") > 0))
    blank = F.col("blank_frames") >= F.greatest(F.lit(2), F.ceil(F.col("frames") * 0.6))
    frozen = F.coalesce(F.col("max_diff") < 1.5, F.lit(False))
    out = s.select(
        "url",
        F.when(blank | frozen, "unknown").otherwise("live").alias("frame_status"),
        F.when(blank, "blank_or_dark_frames").when(frozen, "frozen_frames").otherwise("frames_ok").alias("detail"),
        F.when(blank | frozen, "active_blank").otherwise("active_streaming").alias("stream_status"),
    )
    urls = frames.select("url").distinct()
    return urls.join(out, "url", "left")


def playlist_fields(body: Column) -> Column:
    """STRUCT<sequence, segments, ended, vod> of a media playlist."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda s: F.trim(s))
    return F.struct(
        F.nullif(F.regexp_extract(body, r"#EXT-X-MEDIA-SEQUENCE:\s*(\d+)", 1), F.lit("")).cast("bigint").alias("sequence"),
        F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("#"))).alias("segments"),
        F.contains(body, F.lit("#EXT-X-ENDLIST")).alias("ended"),
        F.contains(F.upper(body), F.lit("#EXT-X-PLAYLIST-TYPE:VOD")).alias("vod"),
    )


def playlist_classes(snapshots: DataFrame) -> DataFrame:
    """(url, taken_at, classification, advanced, changed, sequence_delta) for each snapshot after the first of its URL.

    vod before live before static before unknown; ends and types count from either snapshot.
    """
    parsed = snapshots.select("url", "taken_at", playlist_fields(F.col("body")).alias("_new"))
    rows = scan.lagged(parsed, ["url"], ["taken_at"], F.col("_new"), "_old").where(F.col("_old").isNotNull())
    new, old = F.col("_new"), F.col("_old.v")
    advanced = F.coalesce(new["sequence"] > old["sequence"], F.lit(False))
    changed = new["segments"] != old["segments"]
    kind = (
        F.when(new["ended"] | old["ended"] | new["vod"] | old["vod"], "vod_playlist")
        .when(advanced | changed, "live_playlist")
        .when(F.coalesce(new["sequence"] == old["sequence"], F.lit(False)), "static_playlist")
        .otherwise("unknown_playlist")
    )
    return rows.select("url", "taken_at", kind.alias("classification"), advanced.alias("advanced"), changed.alias("changed"), (new["sequence"] - old["sequence"]).alias("sequence_delta"))


def visual_verdicts(frames: DataFrame, playlists: DataFrame) -> DataFrame:
    """(url, status, substatus, confidence): from darkness, likeness of neighbours and, with growing segments, recurrence."""
    s = frame_summary(frames.where(F.size("pixels") > 0)).join(playlists.groupBy("url").agg(F.bool_or("changed").alias("growing")), "url", "left")
    likeness = 1 - F.coalesce("mean_diff", F.lit(0.0)) / 255.0
    loop = (F.coalesce("still_share", F.lit(1.0)) > 0.95) & F.coalesce("growing", F.lit(False))

    def verdict(status_: str, substatus: str, confidence: float) -> Column:
        return F.struct(F.lit(status_).alias("status"), F.lit(substatus).alias("substatus"), F.lit(confidence).alias("confidence"))

    made = (
        F.when(loop, verdict("unknown", "active_prerecorded_loop_short", 0.6))
        .when(F.col("near_black_share") > 0.98, verdict("unknown", "decode_failed", 0.4))
        .when(likeness > 0.995, verdict("live", "active_live_static_view", 0.65))
        .otherwise(verdict("live", "active_live_dynamic", 0.7))
    )
    out = s.select("url", made.alias("v")).select("url", "v.*")
    urls = frames.select("url").distinct().join(out, "url", "left")
    return urls.select("url", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("substatus", F.lit("decode_failed")).alias("substatus"), F.coalesce("confidence", F.lit(0.2)).alias("confidence"))
