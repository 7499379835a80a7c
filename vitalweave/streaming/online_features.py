"""The online view of features as a stream with keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vitalweave.functions.groups import latest_per_key
from vitalweave.operators.features import ONLINE_TTL, online_features
from vitalweave.streaming.flow import store_updates

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "version long, features string, source string, created long"
CHANGES = "entity_id string, version long, features string, source string, created long, alive boolean"


class NewestRow(StatefulProcessor):
    """Keeps the newest row of an entity until its time to live has passed on the event clock."""

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best = held = tuple(held) if held else None
        for part in rows:
            part = part.sort_values(["created", "version"])
            row = tuple(part[["version", "features", "source", "created"]].iloc[-1])
            if best is None or (row[3], row[0]) > (best[3], best[0]):
                best = row
        if best is not None and best != held:
            if held is not None:
                self.handle.deleteTimer(self._expiry(held))
            self.newest.update((int(best[0]), best[1], best[2], int(best[3])))
            self.handle.registerTimer(self._expiry(best))
            yield self._change(key, best, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            held = tuple(self.newest.get())
            if self._expiry(held) <= expiredTimerInfo.getExpiryTimeInMs():
                self.newest.clear()
                yield self._change(key, held, False)

    def _expiry(self, row: tuple) -> int:
        """The first millisecond at which the row is no longer alive."""
        return -(-(int(row[3]) + self.ttl) // 1000)

    @staticmethod
    def _change(key: tuple, row: tuple, alive: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], int(row[0]), row[1], row[2], int(row[3]), alive]], columns=["entity_id", "version", "features", "source", "created", "alive"])


def online_changes(rows: DataFrame, ttl: timedelta = ONLINE_TTL) -> DataFrame:
    """Changes of the online view: an entity's new newest row, or its last row when that is no longer alive.

    ``rows`` is a stream of (entity_id, version, features, created_at, source_id). The event clock is
    the newest creation time less the time to live, so a row that could still count is never late.
    A state that no row follows leaves the store one time to live after its row has ended.
    """
    if ttl <= timedelta(0):
        raise ValueError("the time to live must be positive")
    span = ttl // timedelta(microseconds=1)
    at = F.col("created_at").cast("timestamp")
    timed = rows.select(
        F.col("entity_id").cast("string").alias("entity_id"), F.col("version").cast("long").alias("version"),
        F.to_json("features").alias("features"), F.col("source_id").cast("string").alias("source"),
        F.unix_micros(at).alias("created"), at.alias("at"),
    )
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    watched = timed.withWatermark("at", f"{span} microseconds")
    return watched.groupBy("entity_id").transformWithStateInPandas(NewestRow(span), CHANGES, "Update", "EventTime")


def run_online(rows: DataFrame, out: str, checkpoint: str, ttl: timedelta = ONLINE_TTL) -> StreamingQuery:
    """Keep the view's changes below ``out``, by batch; a restart goes on from the checkpoint."""
    return store_updates(online_changes(rows, ttl), out, checkpoint)


def read_online(spark: SparkSession, out: str, as_of: Column, ttl: timedelta = ONLINE_TTL) -> DataFrame:
    """The view at ``as_of``, which must not lie before the newest row: (entity_id, version, features, created_at, source_id)."""
    changes = spark.read.parquet(out).filter("alive")
    newest = latest_per_key(changes, ["entity_id"], ["created", "version"])
    rows = newest.select(
        "entity_id", "version", F.from_json("features", "map<string,string>").alias("features"),
        F.timestamp_micros("created").cast("timestamp_ntz").alias("created_at"), F.col("source").alias("source_id"),
    )
    return online_features(rows, as_of, ttl)


def entities_held(spark: SparkSession, out: str) -> DataFrame:
    """(entity_id) of the entities whose state has not expired."""
    changes = spark.read.parquet(out)
    return latest_per_key(changes, ["entity_id"], ["batch_id", "created", "version"]).filter("alive").select("entity_id")


