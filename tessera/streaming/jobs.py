"""Streaming jobs: intake, exact and bounded deduplication, the stream fork, health state, log heartbeat, playlists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import urls as U
from tessera.operators import extract as X
from tessera.operators.resolve import deduplicate
from tessera.operators.status import playlist_fields
from tessera.streaming.ordered import folded


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, fmt: str = "json") -> DataFrame:
    """Files that arrive in a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def new_urls(candidates: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Candidates, unwrapped, whose URL hasn't come before.

    Without a delay that is exact and the state keeps every URL; with one, URLs are forgotten once the
    watermark has passed them by the delay.
    """
    rows = candidates.withColumn("url", U.unwrapped(F.col("url")))
    if event_time and delay:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    return rows.dropDuplicates(["url"])


def fork(candidates: DataFrame, streams_path: str, others_path: str, checkpoint: str) -> StreamingQuery:
    """Write streams and the rest to two tables, both from the same batch; a batch that runs again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        stream = U.is_stream(F.col("url"), "loose")
        batch.persist()
        batch.where(stream).write.mode("overwrite").parquet(f"{streams_path}/batch={number}")
        batch.where(~stream).write.mode("overwrite").parquet(f"{others_path}/batch={number}")
        batch.unpersist()

    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enriched(candidates: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table; the table is read anew in each batch."""
    return candidates.join(dimension, key, "left")


STREAKS = "id string, checks bigint, streak bigint, status string, changed boolean, review boolean, old_status string, at bigint"


def health_states(log: DataFrame, threshold: int = 4, delay: str = "10 minutes") -> DataFrame:
    """Streak, change and review flags of every health check; log: id, ts, seq, status.

    The checks of an id go by (ts, seq) over all batches: one that comes late, but within the delay, takes its place.
    A check is told once the watermark has passed it. State per id: streak, last status, number of checks.
    """

    def step(key: str, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        at, _, status = row
        streak, last, checks = state or (0, None, 0)
        streak = streak + 1 if status == "dead" else 0 if status == "live" else streak
        told = (key, checks + 1, streak, status, checks > 0 and status != last, streak >= threshold, last, at)
        return (streak, status, checks + 1), [told]

    rows = log.select(F.col("id").alias("key"), "ts", "seq", "status")
    out = folded(rows, "ts", delay, [("status", "string")], "streak bigint, status string, checks bigint", STREAKS, step)
    return out.withColumn("ts", F.timestamp_micros("at")).drop("at")


def windowed_lines(lines: DataFrame, every: str = "1 minute", delay: str = "10 minutes", leaks: str | None = None) -> DataFrame:
    """(window, stage, lines, leaks) of a log stream (text, logged_at); leaks counts lines that match a pattern."""
    rows = lines.withWatermark("logged_at", delay).withColumn("stage", X.line_stage(F.col("text")))
    hit = F.col("text").rlike(leaks) if leaks else F.lit(False)
    return rows.groupBy(F.window("logged_at", every), "stage").agg(F.count("*").alias("lines"), F.count_if(hit).alias("leaks"))


def alerts(beats: DataFrame, most: int) -> DataFrame:
    """Windows with more leaks than allowed."""
    return beats.where(F.col("leaks") > most)


#: What a beat tells: state of a run at the end of an interval in which it wrote.
BEATS = "run string, beat bigint, stage string, lines bigint, hits bigint, counters string, stop_at bigint"
#: Counters that add up; of the others the last known value counts (fixed values).
SUMMED = ("geojson_features_written", "geojson_features_skipped")


def heartbeat(lines: DataFrame, every_seconds: int = 60, delay: str = "10 minutes", leaks: str | None = None, stop_hits: int = 1, grace_seconds: int = 0) -> DataFrame:
    """(run, beat, stage, lines, hits, counters, stop, stop_at) of log streams (run, text, logged_at, seq), in order.

    A beat comes at the end of every interval in which a run wrote a line: its latest stage, how many lines and lines
    with a leak it has written in all, its counters as of then, and whether it is to be stopped. That is said by the
    first leak that is the stop_hits-th or later and comes grace_seconds or more after the run's first line; a run
    that is to be stopped stays so. leaks: a pattern; without it nothing is a leak.
    """
    t, step_us, grace_us = F.coalesce(F.col("text"), F.lit("")), every_seconds * 1_000_000, grace_seconds * 1_000_000
    told = X.log_lines(lines.select(F.col("run").alias("key"), "logged_at", "seq", t.alias("text")))
    names = [n for of, *_ in X.METRICS for n in of if not n.endswith("tier_counts")]
    said = F.to_json(F.struct(*names), {"ignoreNullFields": "true"})
    hit = F.col("text").rlike(leaks) if leaks else F.lit(False)
    rows = told.select("key", "logged_at", "seq", "stage", hit.cast("int").alias("hit"), said.alias("said"))

    def step(key: str, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        at, _, stage, hit, said = row
        first, lines, hits, latest, counters, stop, beat = state or (at, 0, 0, None, (), None, None)
        if said != "{}":
            counters = dict(counters)
            for name, value in json.loads(said).items():
                counters[name] = counters.get(name, 0) + value if name in SUMMED else value
            counters = tuple(counters.items())
        hits += hit
        if stop is None and hit and hits >= stop_hits and at - first >= grace_us:
            stop = at
        beat = (at // step_us + 1) * step_us
        return (first, lines + 1, hits, stage or latest, counters, stop, beat), []

    def woken(key: str, state: tuple) -> tuple[tuple, list]:
        first, lines, hits, latest, counters, stop, beat = state
        return (*state[:-1], None), [(key, beat, latest, lines, hits, json.dumps(dict(counters), sort_keys=True), stop)]

    kept = "first bigint, lines bigint, hits bigint, stage string, counters map<string,bigint>, stop bigint, beat bigint"
    fields = [("stage", "string"), ("hit", "int"), ("said", "string")]
    out = folded(rows, "logged_at", delay, fields, kept, BEATS, step, wake=lambda state: state[-1], woken=woken)
    times = {c: F.timestamp_micros(c) for c in ("beat", "stop_at")}
    return out.withColumn("stop", F.col("stop_at").isNotNull()).withColumns({**times, "counters": F.from_json("counters", "map<string,bigint>")})


PLAYLISTS = "url string, at bigint, classification string, sequence_delta bigint"


def playlist_states(snapshots: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Class of each snapshot against the one before it of its URL, in order over all batches; the state is that snapshot's fields."""
    p = playlist_fields(F.col("body"))
    rows = snapshots.select(F.col("url").alias("key"), "taken_at", F.xxhash64("body").alias("seq"), p.alias("p"))
    rows = rows.select("key", "taken_at", "seq", "p.sequence", F.to_json("p.segments").alias("segments"), (F.col("p.ended") | F.col("p.vod")).cast("int").alias("closed"))

    def step(key: str, old: tuple | None, row: tuple) -> tuple[tuple, list]:
        at, _, sequence, segments, closed = row
        if old is None:
            return (sequence, segments, closed), []
        before, delta = old[0], None
        if sequence is not None and before is not None:
            delta = sequence - before
        changed = segments != old[1] or delta is not None and delta > 0
        kind = "vod_playlist" if closed or old[2] else "live_playlist" if changed else "static_playlist" if delta == 0 else "unknown_playlist"
        return (sequence, segments, closed), [(key, at, kind, delta)]

    fields = [("sequence", "bigint"), ("segments", "string"), ("closed", "int")]
    out = folded(rows, "taken_at", delay, fields, "sequence bigint, segments string, closed int", PLAYLISTS, step)
    return out.select("url", F.timestamp_micros("at").alias("taken_at"), "classification", "sequence_delta")


def run_to_end(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process all that has arrived and stop; started again it goes on where it stopped."""
    rows.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def finalised(spark: SparkSession, query: StreamingQuery, path: str) -> DataFrame:
    """Duplicates are resolved over the whole set, so this waits for an intake stream to end and works on the table it wrote.

    path: the sink's Parquet folder, with the columns of resolve.deduplicate(). A stream that failed raises here.
    """
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return deduplicate(spark.read.parquet(path))
