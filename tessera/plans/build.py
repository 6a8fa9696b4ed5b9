"""Whole runs: a batch build of the catalogue, and its maintenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import extract, gates, geo, reports, resolve, status, windows


#: Most rows that the stages of a run hand on, and what catalogue mode raises some of them to at least (fixed values).
CAPS = {
    "candidates": 30, "streams": 10, "search_queries": 25, "search_results_per_query": 10, "feed_endpoints": 100, "feed_records": 3000,
    "stream_candidates": 2500, "per_source_streams": 500, "deep_pages": 100, "links_per_page": 25, "scripts_per_page": 20,
}
CATALOGUE_LEAST = {"search_queries": 50, "search_results_per_query": 20, "deep_pages": 300, "candidates": 500, "streams": 250}


def stage_caps(catalogue_mode: bool = False, **chosen: int) -> dict[str, int]:
    """CAPS with those chosen for a run; in catalogue mode none is below its least."""
    unknown = chosen.keys() - CAPS.keys()
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    caps = {**CAPS, **chosen}
    return {k: max(v, CATALOGUE_LEAST.get(k, v)) for k, v in caps.items()} if catalogue_mode else caps


def capped(rows: DataFrame, caps: dict[str, int], stage: str, order: str = "seq", per: str | None = None) -> DataFrame:
    """The first rows of a stage in their order, as many as its cap; of each value of `per`, if given."""
    if per:
        return windows.top_per_group(rows, [per], [order], caps[stage])
    return rows.orderBy(order).limit(caps[stage])


@dataclass
class Observations:
    """What was seen outside: tables, see the operators for their columns."""

    pages: DataFrame
    probes: DataFrame
    stream_map: DataFrame
    offline: DataFrame
    playlists: DataFrame
    robots: DataFrame
    gazetteer: DataFrame
    continents: DataFrame
    blocked: DataFrame
    frames: DataFrame | None = None


def build_catalogue(candidates: DataFrame, seen: Observations, as_of: str, minimum: str = "medium") -> DataFrame:
    """Candidates to deduplicated records: extract, gate, resolve status, enrich, merge. seq is the order of arrival."""
    rows = windows.first_wins(candidates.withColumn("url", U.unwrapped(F.col("url"))), ["url"])
    rows = gates.without_blocked(rows, seen.blocked)
    rows = extract.expand_candidates(rows, seen.pages)
    rows = windows.first_wins(rows.where(U.reject_reason(F.col("url")).isNull()), ["url"])
    rows = gates.robots_gate(rows, gates.robots_policies(seen.robots))
    rows = status.resolve(rows, seen.probes, seen.stream_map, seen.offline, seen.frames, seen.playlists, minimum)
    rows = geo.with_coordinates(geo.looked_up(rows, seen.gazetteer))
    rows = rows.withColumns({"country": F.coalesce("country", "geo.country"), "region": F.coalesce("state_region", "geo.region")})
    rows = geo.records(geo.with_continent(rows, seen.continents), as_of)
    return resolve.deduplicate(rows)


def maintain(records: DataFrame, checks: DataFrame, log: DataFrame, threshold: int = 4, order: Sequence[str] = ("ts",)) -> dict[str, DataFrame]:
    """records with new status, changes, review queue, newly dead ids and summary, by these names.

    checks: id, status, checked_at; log: id, status and the columns of `order`, of all checks.
    """
    return {
        "records": reports.with_health(records, checks),
        "changes": windows.status_changes(log, order=order),
        "review": windows.review_queue(windows.failure_streaks(log, order=order), threshold),
        "newly_dead": reports.newly_dead(records, checks),
        "summary": reports.health_summary(records, checks),
    }
