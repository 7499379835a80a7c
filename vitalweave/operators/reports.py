"""Operational reports over requests, jobs, facts and prediction logs. ``as_of`` stands for the current time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.ranges import exact_quantiles
from vitalweave.functions.scalars import blank_to, clean, present, seconds_between, utc_text

HOUR, MINUTE, WEEK = timedelta(hours=1), timedelta(minutes=1), timedelta(days=7)
# List sizes and the limits of the health ladder.
RECENT_REQUESTS, RECENT_INCIDENTS, TOP_REASONS, ALERT_ROWS = 25, 20, 5, 25
LOG_ROWS, LOG_EVENTS = 200, 25
BACKLOG_LIMIT, ALERT_LIMIT = 5, 25


def within(at: str, as_of: Column, span: timedelta) -> Column:
    return (F.col(at) > as_of - F.lit(span)) & (F.col(at) <= as_of)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side, put together without a join."""
    rows, names = first, list(first.columns)
    for other in others:
        rows = rows.unionByName(other, allowMissingColumns=True)
        names += other.columns
    return rows.agg(*[F.max(n).alias(n) for n in names])


def overview(
    requests: DataFrame, jobs: DataFrame, facts: DataFrame, as_of: Column, recent: timedelta = HOUR, rate: timedelta = MINUTE
) -> DataFrame:
    """One row of platform figures: one conditional pass over each of the three tables."""
    status = F.col("status")
    elapsed = seconds_between("created_at", "updated_at") * 1000
    published = within("updated_at", as_of, recent) & (status == "published")
    r = requests.agg(
        F.avg(F.when(published, elapsed)).alias("publish_latency_ms"),
        _count(within("created_at", as_of, rate)).alias("requests_recent"),
        _count(status != "published").alias("backlog"),
        _count((status == "failed") & (F.to_date("updated_at") == F.to_date(as_of))).alias("failed_today"),
    )
    j = jobs.agg(_count(status.isin("queued", "running")).alias("jobs_active"))
    f = facts.agg(_count(within("timestamp", as_of, rate)).alias("facts_recent"))
    return one_row(r, j, f)


def ladder(first: Column, second: Column) -> Column:
    """healthy when both hold, degraded when one does, else failing."""
    return F.when(first & second, "healthy").when(first | second, "degraded").otherwise("failing")


def stage_health(figures: DataFrame) -> DataFrame:
    """Health of the three stages as rows of (stage, status, details)."""
    ingest = F.struct(
        F.lit("ingestion").alias("stage"),
        ladder(F.col("backlog") < BACKLOG_LIMIT, F.col("requests_recent") > 0).alias("status"),
        F.format_string("%d requests, backlog %d", "requests_recent", "backlog").alias("details"),
    )
    privacy = F.struct(
        F.lit("privacy").alias("stage"),
        ladder(F.col("failed_today") < ALERT_LIMIT, F.lit(True)).alias("status"),
        F.format_string("%d failures today", "failed_today").alias("details"),
    )
    facts = F.struct(
        F.lit("normalization").alias("stage"),
        ladder(F.col("facts_recent") > 0, F.col("jobs_active") >= 0).alias("status"),
        F.format_string("%d facts, %d jobs active", "facts_recent", "jobs_active").alias("details"),
    )
    return figures.select(F.inline(F.array(ingest, privacy, facts)))


def request_summary(requests: DataFrame, as_of: Column, recent: timedelta = HOUR, rate: timedelta = MINUTE) -> DataFrame:
    """Counts by status in the recent window, total backlog and throughput. Failed requests are the dead letters."""
    status, fresh = F.col("status"), within("created_at", as_of, recent)
    return requests.agg(
        _count(fresh & (status == "accepted")).alias("accepted"),
        _count(fresh & (status == "published")).alias("published"),
        _count(fresh & (status == "failed")).alias("failed"),
        _count(fresh & (status == "failed")).alias("dead_letters"),
        _count(status != "published").alias("backlog"),
        _count(within("created_at", as_of, rate)).alias("throughput"),
    )


REQUEST_COLUMNS = ("id", "source", "format", "status", "retry_count", "created_at", "updated_at")


def recent_requests(requests: DataFrame, n: int = RECENT_REQUESTS) -> DataFrame:
    """Newest requests; a blank error is null."""
    newest = requests.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.select(*REQUEST_COLUMNS, F.when(present("error").isNotNull(), F.col("error")).alias("error"))


def privacy_stats(requests: DataFrame, vault: DataFrame, as_of: Column) -> DataFrame:
    """Failed and accepted requests of the day, failure rate and vault size."""
    today = F.to_date("created_at") == F.to_date(as_of)
    counts = requests.agg(
        _count(today & (F.col("status") == "failed")).alias("failed_today"),
        _count(today & (F.col("status") == "accepted")).alias("accepted_today"),
    )
    size = vault.agg(F.count("*").alias("vault_size"))
    handled = F.col("failed_today") + F.col("accepted_today")
    rate = F.when(handled > 0, F.col("failed_today") / handled).otherwise(F.lit(0.0))
    return one_row(counts, size).withColumn("failure_rate", rate)


def top_reasons(requests: DataFrame, n: int = TOP_REASONS) -> DataFrame:
    failed = requests.filter(F.col("status") == "failed")
    counts = failed.groupBy(blank_to("error", "Unknown reason").alias("reason")).agg(F.count("*").alias("failures"))
    return counts.orderBy(F.desc("failures"), F.asc("reason")).limit(n)


def recent_incidents(requests: DataFrame, n: int = RECENT_INCIDENTS) -> DataFrame:
    """Newest failed requests with the trimmed error."""
    failed = requests.filter(F.col("status") == "failed")
    newest = failed.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)
    return newest.select(*REQUEST_COLUMNS, clean(F.coalesce(F.col("error"), F.lit(""))).alias("error"))


def latency_by_minute(logs: DataFrame, as_of: Column, span: timedelta = timedelta(hours=2)) -> DataFrame:
    recent = logs.filter(within("created_at", as_of, span))
    minute = F.date_trunc("minute", F.col("created_at")).cast("timestamp_ntz")
    return recent.groupBy(minute.alias("minute")).agg(F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("latency_ms"))


def newest_logs(logs: DataFrame, n: int | None = LOG_ROWS) -> DataFrame:
    """Newest ``n`` logs, or all of them when ``n`` is None."""
    if n is None:
        return logs
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def prediction_summary(logs: DataFrame, n: int | None = None) -> DataFrame:
    """Count, covered seconds, exact interpolated quantiles and means of all logs, or of the newest ``n``.

    Quantiles of all logs are selected by histograms, so that no task gathers all values.
    """
    newest = newest_logs(logs, n)
    span = F.floor(seconds_between(F.min("created_at"), F.max("created_at")))
    if n is None:
        middle, high = (F.lit(x).cast("double") for x in exact_quantiles(logs, "latency_ms", [0.5, 0.95]))
    else:
        middle, high = F.percentile("latency_ms", 0.5), F.percentile("latency_ms", 0.95)
    return newest.agg(
        F.count("*").alias("total"),
        F.coalesce(span, F.lit(0)).cast("bigint").alias("window_seconds"),
        F.coalesce(middle, F.lit(0.0)).alias("p50_latency_ms"),
        F.coalesce(high, F.lit(0.0)).alias("p95_latency_ms"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_latency_ms"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )


def prediction_events(logs: DataFrame, n: int = LOG_EVENTS) -> DataFrame:
    return newest_logs(logs, n).select("id", "patient_id", "model_name", "latency_ms", "confidence", "created_at")


def alert_counts(requests: DataFrame, as_of: Column, span: timedelta = WEEK) -> DataFrame:
    status = F.col("status")
    return requests.filter(within("updated_at", as_of, span)).agg(
        _count(status == "failed").alias("critical"),
        _count(status == "accepted").alias("warning"),
        _count(status == "published").alias("info"),
    )


def alert_items(requests: DataFrame, n: int = ALERT_ROWS) -> DataFrame:
    """Newest failed or waiting requests. A payload that is no JSON object is kept as raw text in one."""
    open_ = requests.filter(F.col("status").isin("failed", "accepted"))
    newest = open_.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)
    payload = F.col("payload")
    decodes = F.try_parse_json(payload).isNotNull() & clean(payload).startswith("{")
    kept = F.when(F.coalesce(payload, F.lit("")) == "", F.lit("{}")).when(decodes, payload)
    return newest.select(
        "id",
        "source",
        "format",
        "status",
        F.coalesce("error", F.lit("")).alias("error"),
        kept.otherwise(F.to_json(F.struct(payload.alias("raw")))).alias("payload"),
        utc_text("updated_at").alias("updated_at"),
    )
