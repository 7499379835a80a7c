"""Texts and their best partners among those that miss at most one byte of each other.

The texts of a block fall into classes: those with the same bytes in any order. A Jaro-Winkler
score asks for a number of equal bytes that follows from the sizes, so the best partner of a
text mostly is in its own class, or in one that a single byte more or less leads to. The classes
are joined by their bytes, without the one that misses; texts are scored class against class, in
tiles, and a pair of texts never becomes a row. A score that is found also says which other
classes could reach it: a text that no other class can serve better is settled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.functions.similarity import PREFIX_LIMIT, PREFIX_WEIGHT, TextBatch, pair_bounds, scores
from vitalweave.session import cut_lineage

SLACK = 1e-6
#: Pairs of texts that are at hand at once, about.
PAIRS = 1 << 18
CLASS = ["_block", "_key"]


def share(score):
    """The least sum of the shares of equal bytes in both texts; the common start may add as much as it ever does."""
    most = PREFIX_LIMIT * PREFIX_WEIGHT
    return 3 * (score - most) / (1 - most) - 1


def equal_bytes(score, size: Column, other: Column) -> Column:
    """Number of equal bytes without which two texts of these sizes score less."""
    return F.ceil(F.lit(share(score)) * size * other / (size + other) - F.lit(SLACK)).cast("int")


def byte_tokens(text: str) -> list[int]:
    """The bytes of a text, each with the number of times that it has come before."""
    seen: Counter = Counter()
    tokens = []
    for byte in text.encode("utf-8"):
        tokens.append(seen[byte] << 8 | byte)
        seen[byte] += 1
    return tokens


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_numbers(texts: pd.Series) -> pd.Series:
    return texts.map(byte_tokens)


@F.pandas_udf(T.BinaryType())
def _letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: bytes(sorted(text.encode("utf-8"))))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _shorter(keys: pd.Series) -> pd.Series:
    """The bytes without one of them, once for each different byte."""
    return keys.map(lambda key: [key[:i] + key[i + 1 :] for i in range(len(key)) if not i or key[i] != key[i - 1]])


def tiles(rows: DataFrame, tile: int, side: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of a group in parts of about ``tile``, and the number of parts of each group."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias(f"_{side}_tiles"))
    numbered = rows.join(sizes, by).withColumn(
        f"_{side}_tile", F.pmod(F.xxhash64("_text"), F.col(f"_{side}_tiles")).cast("int")
    )
    # Without this exchange the grouping would reuse the partitions of the join, one per group.
    spread = numbered.repartition(*by, f"_{side}_tile")
    items = F.collect_list(F.struct(*[c for c in ("_text", "_ref", "_floor") if c in rows.columns]))
    grouped = spread.groupBy(*by, f"_{side}_tile").agg(items.alias(f"_{side}"))
    return grouped, sizes


def best_of_pairs(left: TextBatch, floors: np.ndarray, right: TextBatch, order: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text of ``left`` that has one among its pairs (i, j): its place, that of the best partner of at least its floor, the score.

    The pair of the highest bound is scored first, and the others only where they could still win.
    Of equal scores the partner that is first in ``order`` wins.
    """
    fixed = right.right_side()
    bounds = np.concatenate([pair_bounds(left, right, fixed, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)])
    best, first = np.array(floors, float), np.lexsort((-bounds, i))
    first = first[np.concatenate(([True], i[first][1:] != i[first][:-1]))]
    found: list[tuple[np.ndarray, ...]] = []

    def score(chosen: np.ndarray) -> None:
        for k in range(0, len(chosen), PAIRS // 4):
            part = chosen[k : k + PAIRS // 4]
            part = part[bounds[part] >= best[i[part]]]
            if len(part):
                value = np.round(scores(left.take(i[part]), right.take(j[part])), 10)
                wins = value >= best[i[part]]
                np.maximum.at(best, i[part][wins], value[wins])
                found.append((i[part][wins], j[part][wins], value[wins]))

    score(first)
    bounds[first] = -1.0
    score(np.flatnonzero(bounds >= best[i]))
    at, partner, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ranked = np.lexsort((order[partner], -value, at))
    if len(ranked):
        ranked = ranked[np.concatenate(([True], at[ranked][1:] != at[ranked][:-1]))]
    return at[ranked], partner[ranked], value[ranked]


def _score_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best partners in pairs of classes (_block, _text, _floor, _texts, _refs), many small ones at once."""
    for batch in batches:
        rows = list(batch.itertuples(index=False))
        sizes = np.array([len(r[1]) * len(r[3]) for r in rows])
        group = np.cumsum(sizes) // PAIRS
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(group)) + 1) if len(rows) else []:
            own = [rows[k] for k in part]
            blocks = [r[0] for r in own for _ in r[1]]
            asked, floors = [x for r in own for x in r[1]], np.concatenate([r[2] for r in own])
            refs = [x for r in own for x in r[4]]
            order = np.unique(np.array(refs, object), return_inverse=True)[1]
            starts = np.cumsum([(0, 0), *((len(r[1]), len(r[3])) for r in own)], axis=0)
            i = np.concatenate([np.repeat(np.arange(a, a + len(r[1])), len(r[3])) for (a, _), r in zip(starts, own)])
            j = np.concatenate([np.tile(np.arange(b, b + len(r[3])), len(r[1])) for (_, b), r in zip(starts, own)])
            at, partner, value = best_of_pairs(TextBatch(asked), floors, TextBatch([x for r in own for x in r[3]]), order, i, j)
            if len(at):
                columns = {"_block": [blocks[k] for k in at], "_text": [asked[k] for k in at], "_ref": [refs[k] for k in partner], "_score": value}
                yield pd.DataFrame(columns)


def _scored(left: DataFrame, right: DataFrame, right_sizes: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(block, text, ref, score): the best partner in each class that ``pairs`` (block, key, other) has for a text's own, or in the same class."""
    met = left.withColumn("_other", F.col("_key")) if pairs is None else left.join(pairs, CLASS)
    other = {"_key": "_other"}
    spread = met.join(right_sizes.withColumnsRenamed(other), ["_block", "_other"]).select(
        "_block", "_other", "_left", "_left_tile", "_key", F.explode(F.sequence(F.lit(0), F.col("_right_tiles") - 1)).alias("_right_tile")
    )
    # Scoring is the work here, not the bytes: a fixed number of partitions keeps adaptive
    # execution from packing many pairs of tiles into one task by their size.
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spread.join(right.withColumnsRenamed(other), ["_block", "_other", "_right_tile"])
    placed = placed.repartition(tasks, "_block", "_other", "_right_tile", "_key", "_left_tile")
    columns = F.col("_left._text"), F.col("_left._floor"), F.col("_right._text").alias("_texts"), F.col("_right._ref").alias("_refs")
    kinds = {c: right.schema["_right"].dataType.elementType["_ref"].dataType.simpleString() if c == "_ref" else right.schema[c].dataType.simpleString() for c in ("_block", "_ref")}
    found = placed.select("_block", *columns).mapInPandas(_score_classes, f"_block {kinds['_block']}, _text string, _ref {kinds['_ref']}, _score double")
    return best_by_text(found)


def best_by_text(found: DataFrame) -> DataFrame:
    """The best of the rows (block, text, ref, score) of each text; of equal scores the smallest ref."""
    top = F.min_by("_ref", F.struct((-F.col("_score")).alias("s"), "_ref"))
    return found.groupBy("_block", "_text").agg(top.alias("_ref"), F.max("_score").alias("_score"))


def _class_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(block, key, other): known classes one byte away from the asked ones (block, key, wider, shorter, beside) where asked for."""
    def lookups(rows: DataFrame, far: int) -> DataFrame:
        return rows.withColumn("_far", F.lit(far))

    less = asked.filter("_shorter OR _beside").select(*CLASS, "_shorter", "_beside", F.explode(_shorter("_key")).alias("_sub"))
    wanted = lookups(asked.filter("_wider").select(*CLASS, F.col("_key").alias("_sub")), 1)
    wanted = wanted.unionByName(lookups(less.filter("_shorter").select(*CLASS, "_sub"), 0))
    wanted = wanted.unionByName(lookups(less.filter("_beside").select(*CLASS, "_sub"), 1))
    whole = known.select("_block", F.col("_key").alias("_other"), F.col("_key").alias("_sub"))
    missing = known.select("_block", F.col("_key").alias("_other"), F.explode(_shorter("_key")).alias("_sub"))
    offered = lookups(whole, 0).unionByName(lookups(missing, 1))
    return wanted.join(offered, ["_block", "_sub", "_far"]).filter("_key <> _other").select(*CLASS, "_other")


def near_matches(asked: DataFrame, known: DataFrame, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Best partners (block, text, ref, score) near the asked texts (block, text), and those texts that others may still serve better.

    ``known`` (block, text, ref) is stored. The second table has the texts that other known ones may serve as well
    or better, with the score to reach (_floor).
    """
    sized = [_letters("_text").alias("_key"), F.octet_length("_text").alias("_size")]
    asked = cut_lineage(asked.select("_block", "_text", *sized))
    known = cut_lineage(known.filter("_text <> ''").select("_block", "_text", "_ref", sized[0]))
    right, right_sizes = tiles(known, tile, "right", CLASS)
    right, right_sizes = cut_lineage(right), cut_lineage(right_sizes)
    own = asked.filter("_size > 0").withColumn("_floor", F.lit(threshold))
    found = cut_lineage(_scored(tiles(own, tile, "left", CLASS)[0], right, right_sizes, None))

    size = F.col("_size")
    scored = asked.join(found.select("_block", "_text", "_score"), ["_block", "_text"], "left")
    floors = scored.withColumn("_floor", F.coalesce("_score", F.lit(threshold))).drop("_score")
    floors = floors.withColumns(
        {
            "_wider": equal_bytes(F.col("_floor"), size, size + 1) <= size,
            "_shorter": (size > 1) & (equal_bytes(F.col("_floor"), size, size - 1) <= size - 1),
            "_beside": equal_bytes(F.col("_floor"), size, size) <= size - 1,
        }
    )
    reach = cut_lineage(floors.filter("_size > 0 AND (_wider OR _shorter OR _beside)"))
    wants = reach.groupBy(*CLASS).agg(*[F.bool_or(c).alias(c) for c in ("_wider", "_shorter", "_beside")])
    pairs = cut_lineage(_class_pairs(wants, right_sizes.select(*CLASS)))
    left, _ = tiles(reach.join(pairs.select(*CLASS).distinct(), CLASS, "left_semi").select(*CLASS, "_text", "_floor"), tile, "left", CLASS)
    found = cut_lineage(best_by_text(found.unionByName(_scored(left, right, right_sizes, pairs))))

    # What has not been scored misses two bytes or more of the larger text.
    sizes = right_sizes.select("_block", F.octet_length("_key").alias("_other")).distinct()
    scored = asked.select("_block", "_text", "_size").join(found.select("_block", "_text", "_score"), ["_block", "_text"], "left")
    floors = scored.select("_block", "_text", "_size", F.coalesce("_score", F.lit(threshold)).alias("_floor"))
    other = F.col("_other")
    need = equal_bytes(F.col("_floor"), size, other)
    open_ = floors.join(sizes, "_block").filter((need <= F.least(size, other)) & (need <= F.greatest(size, other) - 2))
    return found, cut_lineage(open_.select("_block", "_text", "_floor").distinct())
