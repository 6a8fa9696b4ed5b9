"""Reports: counts, profiles, funnels, performance, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators.contains import containing


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: total, live, dead, unknown, and timeout, which is part of unknown."""
    return rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("live", "dead", "unknown")],
        F.count_if((F.col("status") == "unknown") & F.coalesce(F.col("fail_reason") == "timeout", F.lit(False))).alias("timeout"),
    )


def failure_reasons(rows: DataFrame) -> DataFrame:
    """(fail_reason, n) of rows dead or unknown, the commonest first."""
    failed = rows.where(F.col("status").isin("dead", "unknown") & F.col("fail_reason").isNotNull())
    return failed.groupBy("fail_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fail_reason")


def source_performance(sent: DataFrame, records: DataFrame) -> DataFrame:
    """Per authority: candidates sent, live, mapped and unlocated records. A union and sums, no join."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    live = F.when(F.col("status") == "live", one).otherwise(zero)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    a = sent.select(U.authority(F.col("url")).alias("source"), one.alias("sent"), zero.alias("live"), zero.alias("mapped"), zero.alias("unknown_location"))
    b = records.select(U.authority(F.col("url")).alias("source"), zero.alias("sent"), live.alias("live"), F.when(located, one).otherwise(zero).alias("mapped"), F.when(~located, one).otherwise(zero).alias("unknown_location"))
    return a.unionByName(b).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("sent", "live", "mapped", "unknown_location")])


def funnel(stages: Sequence[tuple[str, DataFrame]], breakdowns: Sequence[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(stage, metric, value): rows of each stage, and per value of a column for breakdowns (stage, rows, column)."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("stage"), F.lit("rows").alias("metric"), "value") for name, df in stages]
    parts += [
        df.groupBy(column).agg(F.count("*").alias("value")).select(F.lit(name).alias("stage"), F.concat(F.lit(f"{column}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).alias("metric"), "value")
        for name, df, column in breakdowns
    ]
    return reduce(DataFrame.unionByName, parts)


def format_breakdown(rows: DataFrame, place: Sequence[str] = ("country", "region", "city"), url: str = "url") -> DataFrame:
    """Counts per place and format bucket with a row total; the grand total is the row whose places are all null and is_total."""
    bucket = U.format_bucket(F.col(url))
    marked = rows.select(*place, *[F.when(bucket == b, 1).otherwise(0).alias(b) for b in U.FORMAT_BUCKETS])
    sums = [F.sum(F.col(f"`{b}`")).alias(b) for b in U.FORMAT_BUCKETS] + [F.count("*").alias("total")]
    per_place = marked.groupBy(*place).agg(*sums).withColumn("is_total", F.lit(False))
    # the grand total adds up the places, not the rows again
    total = per_place.agg(*[F.sum(F.col(f"`{b}`")).alias(b) for b in (*U.FORMAT_BUCKETS, "total")])
    total = total.select(*[F.lit(None).cast("string").alias(p) for p in place], *[F.col(f"`{b}`") for b in U.FORMAT_BUCKETS], "total", F.lit(True).alias("is_total"))
    return per_place.unionByName(total).orderBy("is_total", *place)


def counts_by(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """(name, n), the commonest first."""
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def domain_counts(rows: DataFrame, url: str = "url") -> DataFrame:
    return counts_by(rows, U.authority(F.col(url)), "domain")


def profile(rows: DataFrame, tops: Sequence[tuple[str, int | None]]) -> DataFrame:
    """(facet, value, n): for each (column, top n) the commonest values, and the located and unlocated rows; one pass by grouping sets."""
    columns = [c for c, _ in tops]
    located = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "located").otherwise("unlocated")
    marked = rows.withColumn("location", located)
    facets = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")) for c in (*columns, "location")]
    counts = marked.select(F.explode(F.array(*facets)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    limits = reduce(lambda e, t: F.when(F.col("facet") == t[0], F.lit(t[1] or 1 << 30)).otherwise(e), tops, F.lit(1 << 30))
    ranked = counts.withColumn("_n", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("_n") <= limits).drop("_n")


def decision_counts(decisions: DataFrame, stage: str = "stage") -> DataFrame:
    """Per gate: accept, reject, review, and answers by fallback, timeout and parse error."""
    has = lambda w: F.contains(F.lower(F.coalesce("reason", F.lit(""))), F.lit(w))
    return decisions.groupBy(stage).agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("accept", "reject", "review")],
        F.count_if(has("fallback")).alias("fallback"),
        F.count_if(has("timeout")).alias("timeout"),
        F.count_if(has("parse_error")).alias("parse_error"),
    )


def artifact_counts(rows: DataFrame, artifact: str, columns: Sequence[str]) -> DataFrame:
    """(artifact, column, value, n) for each of the status columns."""
    tall = rows.select(artifact, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([artifact], list(columns), "column", "value")
    return tall.where(F.col("value").isNotNull()).groupBy(artifact, "column", "value").agg(F.count("*").alias("n"))


#: Errors told by log text (fixed values).
ERROR_PATTERNS = (
    ("ssl_cert_verify_failed", "CERTIFICATE_VERIFY_FAILED|unable to get local issuer certificate|SSL certificate verification failed"),
    ("insecure_fallback_used", "fallback succeeded|retrying.*without certificate verification|verify=False"),
    ("http_403", r"\b403\b|Forbidden"),
    ("http_404", r"\b404\b|Not Found"),
    ("remote_protocol", "RemoteProtocolError|Server disconnected"),
    ("timeout", "timeout|timed out"),
)


def error_counts(rows: DataFrame, artifact: str, text: str, patterns: Sequence[tuple[str, str]] = ERROR_PATTERNS) -> DataFrame:
    """(artifact, error, n): occurrences of each pattern in the texts of an artifact."""
    sums = rows.groupBy(artifact).agg(*[F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?i){p}"))).alias(name) for name, p in patterns])
    return sums.unpivot([artifact], [name for name, _ in patterns], "error", "n")


def cap_audit(metrics: DataFrame, caps: DataFrame) -> DataFrame:
    """(metric, value, cap_name, cap_value) of metrics whose name holds a cap's hint and whose value is above it."""
    m = metrics.select("metric", F.col("value").try_cast("double").alias("value"), F.lower("metric").alias("_name")).where(F.col("value").isNotNull())
    c = caps.select("cap_name", F.col("cap_value").cast("double").alias("cap_value"), F.lower("hint").alias("_hint"))
    return containing(m, "_name", c, "_hint").where(F.col("value") > F.col("cap_value")).select("metric", "value", "cap_name", "cap_value")


def export_summary(received: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: received, deduplicated away, unique, written (located) and skipped."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    r = received.agg(F.count("*").alias("received"))
    u = unique.agg(F.count("*").alias("unique"), F.count_if(located).alias("written"), F.count_if(~located).alias("skipped"))
    return r.join(u).select("received", (F.col("received") - F.col("unique")).alias("deduplicated"), "unique", "written", "skipped")


def newly_dead(before: DataFrame, checks: DataFrame) -> DataFrame:
    """(id): what is dead by its check and wasn't before, a row each."""
    dead = checks.where(F.col("status") == "dead").select("id").distinct()
    return dead.join(before.where(F.col("status") == "dead").select("id"), "id", "left_anti")


def health_summary(before: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: totals of the checks, and how many ids are newly dead."""
    totals = checks.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("live", "dead", "unknown")])
    return totals.join(newly_dead(before, checks).agg(F.count("*").alias("newly_dead")))  # a row each


def with_health(records: DataFrame, checks: DataFrame) -> DataFrame:
    """Records with their check's status; those without one are kept as they are."""
    c = checks.select("id", F.col("status").alias("_status"), F.col("checked_at").alias("_at"))
    out = records.join(c, "id", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "last_verified": F.coalesce("_at", "last_verified")}).drop("_status", "_at")
