"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Rows are reduced to the SHA-256 digest of their text. Misra-Gries counters name the digests
that may be frequent. An exact aggregate of those digests alone verifies them and finds the row that stays of each; these
winners, a bounded number, are broadcast, so that rows with frequent texts are settled where
they are read. Only the digests that are left are shuffled, and none of them has many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalweave.llm.common import stored
from vitalweave.llm.frequent import FREQUENT, TRACKED, frequent_keys


def text_digest(text: str) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256))


def frequent_winners(rows: DataFrame, place: Column, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """(_digest, _best, _size) of the frequent values of ``_digest``: the greatest ``place`` and the number of their rows.

    The counters only choose which digests are looked at; sizes and places come from an exact
    aggregate with map-side combine. Digests of one row are left out. At most ``frequent`` rows.
    """
    asked = frequent_keys(rows, "_digest", tracked, frequent)
    listed = rows.withColumn("_key", F.xxhash64("_digest")).join(F.broadcast(asked), "_key", "left_semi")
    exact = listed.groupBy("_digest").agg(F.max(place).alias("_best"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    return exact.orderBy(F.desc("_size"), "_digest").limit(frequent)


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if their bytes are; null counts as the empty text. Of equal texts the row
    with the largest id stays, ``keep_id`` is that id; a null id comes before all others, and
    of rows with the same id and text exactly one stays. Digests are stored once, with a
    number for each row that settles such ties. Long texts are read whole; other columns are
    not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(f"`{doc_id}`").alias("_id"), text_digest(text).alias("_digest"), (-F.monotonically_increasing_id()).alias("_row")))
    place = F.struct("_id", "_row")
    winners = F.broadcast(stored(frequent_winners(rows, place, tracked, frequent)))
    settled = rows.join(winners, "_digest")
    group = Window.partitionBy("_digest")
    others = rows.join(winners, "_digest", "left_anti")
    others = others.select("_digest", "_id", "_row", F.max(place).over(group).alias("_best"), F.count(F.lit(1)).over(group).alias("_size"))
    return settled.unionByName(others).select(
        F.col("_id").alias("doc_id"),
        F.col("_best._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_best._row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text: that with the largest id.

    Nulls, ties and empty tables as in :func:`mark_copies`, except that any one of rows with
    the same id and text stays. Rows of frequent texts go where they are read; of those that
    are left, a task sends one of each text at most. Columns may have any names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, content = (names[docs.columns.index(c)] for c in (doc_id, text))
    rows = plain.withColumn("_digest", text_digest(content))
    winners = stored(frequent_winners(rows, F.col(own), tracked, frequent))
    left = rows.join(F.broadcast(winners), "_digest", "left").filter(F.col("_size").isNull() | F.col(own).eqNullSafe(F.col("_best")))
    first = Window.partitionBy("_digest").orderBy(F.desc_nulls_last(own))
    kept = left.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return kept.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
