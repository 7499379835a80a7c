"""Versioned feature store: rows of (entity_id, version, features, created_at)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key
from vitalweave.functions.scalars import present, utc_text

# Life of an online row and size of a feature view.
ONLINE_TTL = timedelta(minutes=5)
VIEW_ROWS = 200


def event_features(facts: DataFrame, entity: str = "master_id") -> DataFrame:
    """Features of each linked record as a map of text; the version is the event time in microseconds.

    ``entity`` is the column that names the entity; where it is blank, the master does.
    """
    pairs = {
        "master_patient_id": F.col("master_id"),
        "resource_type": F.lower("resource_type"),
        "event_time": utc_text("timestamp"),
        "value": F.col("value").cast("string"),
        "unit": F.col("unit"),
        "concept": F.col("concept"),
    }
    flat = [part for name, value in pairs.items() for part in (F.lit(name), value)]
    return facts.select(
        (F.col(entity) if entity == "master_id" else F.coalesce(present(entity), "master_id")).alias("entity_id"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("version"),
        F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull()).alias("features"),
        F.col("timestamp").alias("created_at"),
        F.col("id").alias("source_id"),
    )


def append_features(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first write of each (entity_id, version) that is not stored yet."""
    rest = [c for c in rows.columns if c not in ("entity_id", "version")]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "source_id"))
    kept = rows.groupBy("entity_id", "version").agg(first.alias("_row"))
    kept = kept.select("entity_id", "version", "_row.*").select(*rows.columns)
    if existing is None:
        return kept
    return kept.join(existing.select("entity_id", "version"), ["entity_id", "version"], "left_anti")


def online_features(df: DataFrame, as_of: Column, ttl: timedelta = ONLINE_TTL) -> DataFrame:
    """Newest row of each entity that is still alive at ``as_of``."""
    if ttl <= timedelta(0):
        raise ValueError("the time to live must be positive")
    alive = df.filter((F.col("created_at") > as_of - F.lit(ttl)) & (F.col("created_at") <= as_of))
    return latest_features(alive)


def latest_features(df: DataFrame) -> DataFrame:
    return latest_per_key(df, ["entity_id"], ["created_at", "version"])


def feature_views(df: DataFrame, ids: DataFrame | None = None, n: int = VIEW_ROWS) -> DataFrame:
    """Newest rows by view id (``entity:version``), of the listed ids when given."""
    rows = df.withColumn("id", F.concat_ws(":", "entity_id", F.col("version").cast("string")))
    if ids is not None:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def resolve_features(online: DataFrame, offline: DataFrame) -> DataFrame:
    """Online features of each entity, else its offline ones. Each side has one row per entity."""
    live = online.select("entity_id", F.col("features").alias("_live"))
    stored = offline.select("entity_id", F.col("features").alias("_stored"))
    hot = F.col("_live").isNotNull() & (F.size("_live") > 0)
    return live.join(stored, "entity_id", "full").select(
        "entity_id",
        F.when(hot, F.col("_live")).otherwise(F.col("_stored")).alias("features"),
        F.when(hot, F.lit("online")).otherwise(F.lit("offline")).alias("feature_source"),
    )
