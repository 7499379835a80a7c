"""Validation, lifecycle, retries and retention of ingestion requests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key
from vitalweave.functions.once import evaluate_once
from vitalweave.functions.scalars import present

# Accepted sources and formats, and the retention period.
SOURCES = ("hospital", "lab", "imaging", "wearable", "telehealth")
FORMATS = ("fhir", "hl7", "json", "csv", "dicom")
RETENTION = timedelta(days=7)


def _allow_list(values: Sequence[str]) -> list[str]:
    return [v.strip().lower() for v in values if v.strip()]


def _checks(value: Column, allowed: list[str], what: str, verb: str) -> list[tuple[Column, Column]]:
    found = [(value.isNull(), F.lit(f"{what} required: invalid {what}"))]
    if allowed:
        text = F.concat(F.lit(f"{what} '"), value, F.lit(f"' not {verb}: invalid {what}"))
        found.append((~value.isin(allowed), text))
    return found


def validate_requests(
    df: DataFrame, sources: Sequence[str] = SOURCES, formats: Sequence[str] = FORMATS, data: str = "data"
) -> DataFrame:
    """Adds ``reason``: the first failed check, or null for a valid request.

    ``data`` names a JSON text or a map column. An empty allow-list accepts any value.
    """
    if df.schema[data].dataType.typeName() == "map":
        empty = F.coalesce(F.size(data), F.lit(0)) <= 0
    else:
        empty = F.coalesce(F.regexp_replace(F.col(data), r"\s+", ""), F.lit("")).isin("", "{}", "null")
    values = {"_source": present(F.lower("source")), "_format": present(F.lower("format")), "_empty": empty}
    ready = evaluate_once(df, values)
    checks = [
        *_checks(F.col("_source"), _allow_list(sources), "source", "allowed"),
        *_checks(F.col("_format"), _allow_list(formats), "format", "supported"),
        (F.col("_empty"), F.lit("missing data payload")),
    ]
    reason = F.when(*checks[0])
    for condition, text in checks[1:]:
        reason = reason.when(condition, text)
    return ready.withColumn("reason", reason).drop(*values)


def latest_status(status_events: DataFrame) -> DataFrame:
    """Current state of each request from its status changes (id, status, error, at, seq)."""
    return latest_per_key(status_events, ["id"], ["at", "seq"])


def retry_counts(attempts: DataFrame) -> DataFrame:
    """Attempts after the first, per request."""
    return attempts.groupBy("id").agg((F.count("*") - 1).alias("retry_count"))


def apply_retention(df: DataFrame, as_of: Column, ttl: timedelta = RETENTION, at: str = "created_at") -> DataFrame:
    """Rows not older than ``ttl``; a period of zero or less keeps everything."""
    if ttl <= timedelta(0):
        return df
    return df.filter(F.col(at) >= as_of - F.lit(ttl))


def status_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")
