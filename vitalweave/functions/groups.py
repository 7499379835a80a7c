"""Grouped building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple for each key.

    An aggregate with map-side combine: a hot key leaves each map task as one row.
    ``order`` must end in a column that is unique within the key.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(newest.alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows of every key in a total order.

    Ranking runs twice: first within (key, salt), which spreads a hot key over
    ``salts`` tasks, then over the at most ``n * salts`` survivors of each key. Spark
    also cuts both rankings to ``n`` before each shuffle. The salt follows the input
    partition, so that a map task keeps ``n`` rows of a key and not ``n`` for each salt;
    the result does not depend on it.
    """
    if n < 1:
        raise ValueError("n must be positive")
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
    kept = kept.drop("_rank", "_salt").withColumn("_rank", F.row_number().over(final))
    return kept.filter(F.col("_rank") <= n).drop("_rank")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key, as column ``name``.

    ``bucket`` must not decrease along ``order``. The pre-aggregated totals of the
    earlier buckets enter each bucket as its first row, and sums run inside (key,
    bucket). A hot key is thus split over its buckets and never sorted in one task,
    and the rows are shuffled once.
    """
    rows = df.withColumn("_value", value).withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_value", F.sum("_total").over(before)).drop("_total").filter("_value IS NOT NULL")
    joined = rows.withColumn("_own", F.lit(1)).unionByName(carried.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumn("_sum", F.sum("_value").over(inside)).filter("_own = 1")
    return summed.select(*df.columns, F.col("_sum").alias(name))
