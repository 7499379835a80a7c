"""Frequent keys by Misra-Gries counters, and joins that settle their rows without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.llm.common import stored

#: Counters of a sketch: a key is named for certain if it has more than about 3.5 / TRACKED of all rows and is among the FREQUENT most common.
TRACKED = 50_000
#: Keys that are named, at most.
FREQUENT = 10_000
#: Sketches of tasks are merged in so many groups first.
GROUPS = 64


def frequent_keys(rows: DataFrame, key: str, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """(_key): 64-bit hashes of the values of ``key`` that may be frequent, at most ``frequent``; counts are up to the reader.

    Spark's frequent-items sketch keeps Misra-Gries counters; it is merged as a tree, and no row is shuffled.
    """
    keys = rows.select(F.xxhash64(key).alias("_key"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_group"))
    parts = keys.groupBy("_group").agg(F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("_counters"))
    # Grouped by a constant: a task without rows would else hold a sketch without state, which cannot be merged.
    named = parts.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_counters, {tracked}), {frequent})").alias("_named"))
    return named.select(F.explode("_named.item").alias("_key"))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """``left`` joined with ``right`` by ``key``, of which ``right`` has each value once; ``how`` is inner or left.

    Rows of the frequent values of ``left`` meet their row of ``right`` by a broadcast of these
    few rows, and null keys meet none; only the other rows are shuffled. ``left`` is read
    three times, so it should be stored or cheap.
    """
    asked = stored(frequent_keys(left.filter(F.col(key).isNotNull()), key, tracked, frequent))
    few = F.broadcast(stored(right.withColumn("_key", F.xxhash64(key)).join(F.broadcast(asked), "_key", "left_semi").drop("_key")))
    known = left.filter(F.col(key).isNotNull())
    joined = known.join(few, key).unionByName(known.join(few.select(key), key, "left_anti").join(right, key, how))
    if how == "inner":
        return joined
    return joined.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
