"""Linking records to master patients, by exact key and by similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import top_n_per_key
from vitalweave.functions.scalars import clean, present
from vitalweave.functions.similarity import TextBatch, best_matches
from vitalweave.operators.near_texts import best_by_text, byte_numbers, equal_bytes, near_matches, tiles
from vitalweave.session import cut_lineage

THRESHOLD = 0.85
RECENT = 100
LINKS_PER_PATIENT = 25
TILE = 1_024


def deterministic_key(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``link_key``: the first configured field with a value, as ``field:value`` in lower case."""
    names = [f.strip().lower() for f in fields if f.strip()]
    parts = [F.concat(F.lit(f"{n}:"), F.lower(present(n))) for n in names if n in df.columns]
    return df.withColumn("link_key", F.coalesce(*parts) if parts else F.lit(None).cast("string"))


def master_id(key: Column) -> Column:
    """Identifier of a new master: a hash of what it was made from, so a replay makes the same one."""
    return F.concat(F.lit("master-"), F.substring(F.sha2(key, 256), 1, 16))


def known_masters(links: DataFrame) -> DataFrame:
    """Newest master of every key, one row per key after map-side combine."""
    newest = F.max_by("master_id", F.struct("created_at", "id"))
    found = links.filter(F.coalesce(F.col("deterministic_key"), F.lit("")) != "")
    return found.groupBy(F.col("deterministic_key").alias("link_key")).agg(newest.alias("known_master"))


def link_deterministic(df: DataFrame, links: DataFrame) -> DataFrame:
    """Adds master_id, score, method and is_new for rows with a ``link_key``; rows without one stay unlinked."""
    return link_known(df, known_masters(links))


def link_known(df: DataFrame, known: DataFrame) -> DataFrame:
    """:func:`link_deterministic` with the table of :func:`known_masters` at hand."""
    joined = df.join(known, "link_key", "left")
    keyed = F.col("link_key").isNotNull()
    return joined.select(
        *df.columns,
        F.when(keyed, F.coalesce("known_master", master_id(F.col("link_key")))).alias("master_id"),
        F.when(keyed, F.lit(1.0)).alias("score"),
        F.when(keyed, F.lit("deterministic")).alias("method"),
        (keyed & F.col("known_master").isNull()).alias("is_new"),
    )


def _score_tiles():
    """Best registry row for each incoming text of a tile pair, in one pass over Arrow batches.

    Pairs with the same registry tile arrive together, so its encoding is kept for the next pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, refs, encoded = None, [], None
        for batch in batches:
            rows: list[tuple] = []
            for block, tile, incoming, floors, texts, numbers in batch.itertuples(index=False):
                if held != (block, tile):
                    order = sorted(range(len(numbers)), key=lambda i: numbers[i])
                    held, refs = (block, tile), [numbers[i] for i in order]
                    encoded = TextBatch([texts[i] for i in order])
                for text, found in zip(incoming, best_matches(list(incoming), encoded, floors)):
                    if found is not None:
                        rows.append((block, text, refs[found[0]], found[1]))
            yield pd.DataFrame(rows, columns=["_block", "_text", "_ref", "_score"])

    return run


def best_candidates(
    incoming: DataFrame, registry: DataFrame, block: str | None, text: str, ref: str, threshold: float, tile: int
) -> DataFrame:
    """(block, text, ref, score) of the best registry row for each distinct incoming text.

    Copies collapse first, equal texts are settled by a plain join, most others by
    :func:`near_matches`, and those that may have a better partner elsewhere are
    scored tile against tile: a pair of rows never becomes a row, no task holds more
    than one tile of each side at a time, and a hot block is spread over its tiles.
    Every registry text of the block is considered.
    """
    def side(df: DataFrame) -> Column:
        return F.col(block) if block else F.lit(0)

    asked = incoming.select(side(incoming).alias("_block"), clean(text).alias("_text")).na.drop().distinct()
    known = registry.select(side(registry).alias("_block"), F.col(text).alias("_text"), F.col(ref).alias("_ref"))
    known = known.na.drop().groupBy("_block", "_text").agg(F.min("_ref").alias("_ref"))

    # Both tables are read several times below, so they are stored once.
    known = cut_lineage(known)
    settled = cut_lineage(asked.join(known, ["_block", "_text"], "left"))
    equal = settled.filter(F.col("_ref").isNotNull()).withColumn("_score", F.lit(1.0))
    near, open_ = near_matches(settled.filter(F.col("_ref").isNull()).drop("_ref"), known, threshold, tile)
    open_ = cut_lineage(reachable(open_, known))
    left, _ = tiles(open_, tile, "left", ["_block"])
    right, right_sizes = tiles(known.join(open_.select("_block").distinct(), "_block", "left_semi"), tile, "right", ["_block"])
    # One copy of an incoming tile per registry tile; pairs of tiles then spread a hot block.
    spread = left.join(right_sizes, "_block").select(
        "_block", "_left_tile", "_left", F.explode(F.sequence(F.lit(0), F.col("_right_tiles") - 1)).alias("_right_tile")
    )
    # Scoring is the work here, not the bytes: a fixed number of partitions keeps adaptive
    # execution from packing many tile pairs into one task by their size.
    tasks = 4 * int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spread.join(right, ["_block", "_right_tile"]).repartition(tasks, "_block", "_right_tile", "_left_tile")
    pairs = placed.select(
        "_block", "_right_tile", "_left._text", "_left._floor", F.col("_right._text").alias("_texts"), F.col("_right._ref").alias("_refs")
    )
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    scored = pairs.mapInPandas(_score_tiles(), f"_block {kinds['_block']}, _text string, _ref {kinds['_ref']}, _score double")
    return equal.unionByName(best_by_text(near.unionByName(scored)))


def reachable(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The asked texts (block, text, floor) that have enough bytes in common with all known texts of some size together."""
    def counted(rows: DataFrame, *names: str) -> DataFrame:
        return rows.select("_block", *names, F.octet_length("_text").alias("_size"), F.explode(byte_numbers("_text")).alias("_token"))

    known = known.join(asked.select("_block").distinct(), "_block", "left_semi").filter("_text <> ''")
    held = cut_lineage(counted(known).distinct().withColumnRenamed("_size", "_other"))
    shared = counted(asked, "_text", "_floor").join(held, ["_block", "_token"]).groupBy("_block", "_text", "_floor", "_size", "_other").count()
    enough = F.col("count") >= equal_bytes(F.col("_floor"), F.col("_size"), F.col("_other"))
    empty = asked.filter("_text = ''")
    return shared.filter(enough).select("_block", "_text", "_floor").distinct().unionByName(empty)


def link_probabilistic(
    incoming: DataFrame,
    registry: DataFrame,
    block: str | None = None,
    threshold: float = THRESHOLD,
    text: str = "patient_id",
    ref: str = "reg_id",
    tile: int = TILE,
) -> DataFrame:
    """Adds ``ref``, ``score`` and ``method``: the best registry row at or above ``threshold``, else new.

    Registry texts are compared as stored, incoming texts trimmed. Ties go to the smallest ``ref``.
    """
    best = best_candidates(incoming, registry, block, text, ref, threshold, tile)
    key = F.col(block) if block else F.lit(0)
    rows = incoming.withColumn("_block", key).withColumn("_text", clean(text))
    joined = rows.join(best, ["_block", "_text"], "left")
    matched = F.col("_ref").isNotNull()
    return joined.select(
        *incoming.columns,
        F.col("_ref").alias(ref if ref not in incoming.columns else f"matched_{ref}"),
        F.when(matched, F.col("_score")).otherwise(F.lit(1.0)).alias("score"),
        F.when(matched, F.lit("probabilistic")).otherwise(F.lit("new")).alias("method"),
    )


def recent_links(links: DataFrame, n: int = RECENT) -> DataFrame:
    """Newest links: the candidate set of the plain similarity match."""
    return links.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def link_recent(
    incoming: DataFrame, links: DataFrame, n: int = RECENT, threshold: float = THRESHOLD, text: str = "patient_id"
) -> DataFrame:
    """Similarity match against the newest ``n`` links only."""
    return link_probabilistic(incoming, recent_links(links, n), None, threshold, text, "master_id")


def link_rows(df: DataFrame, attributes: Sequence[str], created_at: str = "timestamp") -> DataFrame:
    """Rows of the link table for linked records."""
    return df.select(
        F.sha2(F.concat_ws("|", "master_id", F.col("id").cast("string")), 256).alias("id"),
        "master_id",
        "patient_id",
        F.coalesce("link_key", F.lit("")).alias("deterministic_key"),
        "score",
        "method",
        F.to_json(F.struct(*attributes)).alias("attributes"),
        F.col(created_at).alias("created_at"),
    )


def links_for(links: DataFrame, patients: DataFrame | None = None, n: int = LINKS_PER_PATIENT) -> DataFrame:
    """Newest ``n`` links of each patient, of the listed patients when given."""
    wanted = links if patients is None else links.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    return top_n_per_key(wanted, ["patient_id"], [F.desc("created_at"), F.desc("id")], n)


def linkage_summary(links: DataFrame, n: int = LINKS_PER_PATIENT) -> DataFrame:
    """Newest master, score and method of each patient, the count of all its links and the newest ``n`` as an array."""
    newest = links_for(links, None, n)
    order = F.struct("created_at", "id")
    counts = links.groupBy("patient_id").agg(F.count(F.lit(1)).alias("link_count"))
    entry = F.struct("created_at", "id", "patient_id", "score", "method", "attributes")
    return newest.groupBy("patient_id").agg(
        F.max_by("master_id", order).alias("master_id"),
        F.max_by("score", order).alias("primary_score"),
        F.max_by("method", order).alias("method"),
        F.sort_array(F.collect_list(entry), asc=False).alias("linked_patients"),
    ).join(counts, "patient_id")
