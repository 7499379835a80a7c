"""Rows sorted over all partitions and kept that way: paging, ordered folds and exact ranks."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.session import cut_lineage

#: Bins of a histogram of values, and rows of a bin that are read as they are.
BINS, FEW = 1024, 10_000
#: Rows of a range of a paged table, about.
RANGE_ROWS = 1_000_000


def sorted_ranges(df: DataFrame, order: Sequence[Column], part: str = "part") -> DataFrame:
    """``df`` in stored ranges of ``order``, each sorted, with the number of the range as column ``part``."""
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))


def rows_after(df: DataFrame, keys: Sequence[str], last: Sequence[object], descending: Sequence[bool] | None = None) -> Column:
    """Whether a row comes after the key ``last``; the bound of the first key alone is there for the file scan."""
    down = list(descending) if descending is not None else [False] * len(keys)
    literals = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, last)]
    beyond = [F.col(k) < x if d else F.col(k) > x for k, x, d in zip(keys, literals, down)]
    same, found = F.lit(True), F.lit(False)
    for k, x, after in zip(keys, literals, beyond):
        found = found | (same & after)
        same = same & (F.col(k) == x)
    return (F.col(keys[0]) <= literals[0] if down[0] else F.col(keys[0]) >= literals[0]) & found


def _orders(keys: Sequence[str], descending: Sequence[bool] | None) -> list[Column]:
    down = list(descending) if descending is not None else [False] * len(keys)
    return [F.desc(k) if d else F.asc(k) for k, d in zip(keys, down)]


def page_after(df: DataFrame, keys: Sequence[str], size: int, last: Sequence[object] | None = None, descending: Sequence[bool] | None = None) -> DataFrame:
    """The ``size`` rows that follow the row with the key ``last``, or the first ones.

    ``keys`` order the rows totally and are not null. Each task keeps ``size`` rows, however deep the page is.
    """
    rows = df if last is None else df.filter(rows_after(df, keys, last, descending))
    return rows.orderBy(*_orders(keys, descending)).limit(max(size, 1))


class PagedTable:
    """Rows stored in sorted ranges with their counts, for jumps to any page.

    A page is read from the ranges that it lies in; of the others only the counts are looked at.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], descending: Sequence[bool] | None = None):
        self.spark, self.path, self.order = spark, path, _orders(keys, descending)
        counts = spark.read.parquet(f"{path}/counts").orderBy("part").collect()
        self.counts = [(r["part"], r["n"]) for r in counts]

    @classmethod
    def build(cls, df: DataFrame, path: str, keys: Sequence[str], descending: Sequence[bool] | None = None, range_rows: int = RANGE_ROWS) -> "PagedTable":
        """Store ``df`` in ranges of about ``range_rows`` rows. ``keys`` order the rows totally and are not null."""
        order = _orders(keys, descending)
        dealt = df.repartitionByRange(max(1, -(-df.count() // range_rows)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        stored = df.sparkSession.read.parquet(f"{path}/rows")
        stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
        return cls(df.sparkSession, path, keys, descending)

    def page(self, size: int, number: int) -> DataFrame:
        """Page ``number`` (from 1); sizes and numbers below one count as one. A page after the last one is empty."""
        size, number = max(size, 1), max(number, 1)
        start, before, wanted, skip = (number - 1) * size, 0, [], 0
        for part, n in self.counts:
            if before + n > start and before < start + size:
                if not wanted:
                    skip = start - before
                wanted.append(part)
            before += n
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("part").isin(wanted))
        return rows.orderBy(*self.order).offset(max(skip, 0)).limit(size).drop("part")


def exact_ranks(df: DataFrame, column: str, ranks: Sequence[int], bins: int = BINS, few: int = FEW) -> dict[int, float]:
    """The values of the given ranks (from 0) in the order of a numeric column, without nulls and NaN.

    A histogram over the whole range is counted with map-side combine; the bin that holds a
    rank is counted anew with its own range, until it is one value or has few rows. No task
    and not the driver holds more than the counts of the bins or the rows of such a bin.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = [(low, high, 0, sorted(set(ranks)))] if low is not None else []
    while open_:
        low, high, before, asked = open_.pop()
        if low == high:
            found.update({r: low for r in asked})
            continue
        inside = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        # Halves, so that the width of a range of any doubles is finite; infinite ends have bins of their own.
        ends = [x for x in (low, high) if isfinite(x)]
        bottom = low if isfinite(low) else (-1.7e308 if ends else 0.0)
        top = high if isfinite(high) else 1.7e308
        share = (F.col("v") / 2 - F.lit(bottom / 2)) / F.lit(top / 2 - bottom / 2)
        bin_ = F.when(F.col("v") < bottom, -1).when(F.col("v") > top, bins + 1).otherwise(F.least(F.floor(share * bins), F.lit(bins)))
        counted = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in counted.orderBy("low").collect():
            own = [r for r in asked if before <= r < before + row["n"]]
            if own and row["n"] <= few and row["low"] != row["high"]:
                part = values.filter((F.col("v") >= F.lit(row["low"])) & (F.col("v") <= F.lit(row["high"])))
                at, held = before, {}
                for value, n in part.groupBy("v").count().orderBy("v").collect():
                    held.update({r: value for r in own if at <= r < at + n})
                    at += n
                found.update(held)
            elif own:
                open_.append((row["low"], row["high"], before, own))
            before += row["n"]
    return found


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """Quantiles by linear interpolation between neighbouring ranks, as ``percentile`` gives them; None without values."""
    total = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    known = exact_ranks(df, column, [r for p in places for r in (floor(p), ceil(p))], bins, few)
    made = []
    for place in places:
        low, high = known[floor(place)], known[ceil(place)]
        made.append(low if low == high else (ceil(place) - place) * low + (place - floor(place)) * high)
    return made
