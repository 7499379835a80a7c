"""Similarity linkage through a kept index, so that only pairs which can still win are scored.

A Jaro-Winkler score asks for a number of equal bytes that follows from the sizes of both
texts. With the bytes of a text put in one order, rare ones first, two texts that have so many
bytes in common share one of the first few. The index holds the bytes of each known text under
(block, size, byte), and a search is a plain join with it. Searches run in rounds of falling
scores: a text that finds a partner in a round cannot find a better one in a later round, and
the higher the score, the fewer bytes need to be looked up.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.functions.scalars import present
from vitalweave.functions.similarity import jaro_winkler
from vitalweave.operators.linkage import THRESHOLD, TILE
from vitalweave.operators.near_texts import SLACK, byte_tokens, equal_bytes, near_matches, share
from vitalweave.session import cut_lineage

#: Scores at which a search looks before it goes down to its threshold.
ROUNDS = (0.97, 0.93, 0.89)
#: Repetitions of a byte in a text that are counted one by one; the order table has 256 times as many rows.
COUNTED = 16
BASE = -1
TEXTS = "block string, text string, size int, ref string, batch_id long"
ENTRIES = "block string, size int, token int, place int, text string, ref string, batch_id long"
ORDER = "token int, n long"


def _in_order(counts: Mapping[int, int]):
    """Tokens of a text, the rarest first; any fixed order gives the same links."""

    def key(token: int) -> tuple[int, int]:
        return (-(token >> 8) if token >> 8 >= COUNTED else counts.get(token, 0)), token

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: sorted(byte_tokens(text), key=key))

    return tokens


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _counted_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [t for t in byte_tokens(text) if t >> 8 < COUNTED])


class MatchIndex:
    """Known texts of one folder by block, with their references; ``before`` hides what that batch and later ones added."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path, self.before = spark, path, before
        order = spark.read.schema(ORDER).parquet(f"{path}/order").collect()
        self.tokens = _in_order({r["token"]: r["n"] for r in order})

    @classmethod
    def build(cls, registry: DataFrame, path: str, block: str, text: str, ref: str) -> "MatchIndex":
        """The index of a registry. ``block`` is required: texts of different blocks are never compared."""
        if not block:
            raise ValueError("similarity linkage needs a block column")
        known = registry.filter(F.col(text).isNotNull())
        counts = known.select(F.explode(_counted_tokens(F.col(text).cast("string"))).alias("token"))
        counts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/order")
        index = cls(registry.sparkSession, path)
        index.add(registry.select(F.col(block).alias("block"), F.col(text).alias("text"), F.col(ref).alias("ref")), BASE)
        return index

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add rows (block, text, ref) under a batch id; a replay writes the same files again. Nulls are left out."""
        known = rows.select(*[F.col(c).cast("string").alias(c) for c in ("block", "text", "ref")]).na.drop()
        known = known.filter("text <> ''").groupBy("block", "text").agg(F.min("ref").alias("ref"))
        sized = cut_lineage(known.withColumn("size", F.octet_length("text")))
        sized.write.mode("overwrite").parquet(f"{self.path}/texts/batch_id={batch_id}")
        # A text looks its own bytes up from the front; no search goes further than this.
        first = F.col("size") - F.ceil(F.lit(max(share(THRESHOLD) - 1, 0.0)) * F.col("size") - F.lit(SLACK)).cast("int") + 1
        entries = sized.select("*", F.posexplode(F.slice(self.tokens("text"), F.lit(1), first)).alias("place", "token"))
        entries.select("block", "size", "token", "place", "text", "ref").write.mode("overwrite").parquet(f"{self.path}/entries/batch_id={batch_id}")

    def _read(self, name: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if self.before is None else rows.filter(F.col("batch_id") < self.before)

    def known(self) -> DataFrame:
        """(block, text, ref) of the known texts."""
        earliest = F.min_by("ref", F.struct("batch_id", "ref"))
        return self._read("texts", TEXTS).groupBy("block", "text").agg(earliest.alias("ref"))

    def candidates(self, asked: DataFrame, score: float) -> DataFrame:
        """(block, text, other, ref): for each asked text (block, text, size, tokens) the known ones that may score as much."""
        sizes = self._read("texts", TEXTS).select("block", F.col("size").alias("_size")).distinct()
        a, b = F.col("size"), F.col("_size")
        probes = asked.join(sizes, "block").withColumn("_need", equal_bytes(score, a, b)).filter(F.col("_need") <= F.least(a, b))
        need = F.col("_need")
        probes = probes.select("block", "text", "_size", need, F.explode(F.slice("tokens", F.lit(1), a - need + 1)).alias("token"))
        entries = self._read("entries", ENTRIES).select("block", F.col("size").alias("_size"), "token", "place", F.col("text").alias("other"), "ref")
        found = probes.join(entries, ["block", "_size", "token"]).filter(F.col("place") <= b - need)
        return found.select("block", "text", "other", "ref").distinct()

    def asked(self, texts: DataFrame) -> DataFrame:
        """Distinct (block, text) to search for, with sizes and tokens; nulls and blank texts are not searched for."""
        rows = texts.select(F.col("block").cast("string").alias("block"), present(F.col("text").cast("string")).alias("text")).na.drop().distinct()
        return rows.select("block", "text", F.octet_length("text").alias("size"), self.tokens("text").alias("tokens"))

    def match(self, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """(block, text, ref, score) of the best known text at or above ``threshold`` for each distinct (block, text).

        Equal texts score one. Of equal scores the smallest ``ref`` wins. Texts without a
        partner have no row.
        """
        if threshold < THRESHOLD:
            raise ValueError(f"the index serves scores from {THRESHOLD} on")
        asked = cut_lineage(self.asked(texts))
        # Blocks that are not asked for are not read further.
        known = cut_lineage(self.known().join(asked.select("block").distinct(), "block", "left_semi"))
        equal = cut_lineage(asked.select("block", "text").join(known, ["block", "text"]).withColumn("score", F.lit(1.0)))
        asked = asked.join(equal.select("block", "text"), ["block", "text"], "left_anti")
        private = {c: f"_{c}" for c in ("block", "text", "ref")}
        near, left = near_matches(asked.select("block", "text").withColumnsRenamed(private), known.withColumnsRenamed(private), threshold, TILE)
        found = [near.toDF("block", "text", "ref", "score")]
        # Other texts may serve those left as well as the best so far, or better.
        asked = cut_lineage(asked.join(left.toDF("block", "text", "floor"), ["block", "text"]))
        for score in [*(r for r in ROUNDS if r > threshold), threshold]:
            if asked.isEmpty():
                break
            found.append(cut_lineage(best_of(self.candidates(asked, score), score)))
            done = found[-1].select("block", "text")
            asked = cut_lineage(asked.filter(F.col("floor") < score).join(done, ["block", "text"], "left_anti"))
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        top = F.min_by("ref", F.struct((-F.col("score")).alias("s"), "ref"))
        best = whole.groupBy("block", "text").agg(top.alias("ref"), F.max("score").alias("score"))
        return cut_lineage(equal.unionByName(best))


def best_of(pairs: DataFrame, score: float) -> DataFrame:
    """(block, text, ref, score): the best of the pairs (block, text, other, ref) that reach ``score``."""
    scored = pairs.withColumn("score", F.round(jaro_winkler(F.col("text"), F.col("other")), 10)).filter(F.col("score") >= score)
    top = F.min_by("ref", F.struct((-F.col("score")).alias("s"), "ref"))
    return scored.groupBy("block", "text").agg(top.alias("ref"), F.max("score").alias("score"))


def link_indexed(incoming: DataFrame, index: MatchIndex, block: str, text: str = "patient_id", ref: str = "reg_id", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``ref`` (as text), ``score`` and ``method``: the best known text of the block at or above ``threshold``, else new."""
    rows = incoming.withColumns({"_block": F.col(block).cast("string"), "_text": present(F.col(text).cast("string"))})
    texts = rows.select(F.col("_block").alias("block"), F.col("_text").alias("text"))
    best = index.match(texts, threshold).select(F.col("block").alias("_block"), F.col("text").alias("_text"), F.col("ref").alias("_ref"), F.col("score").alias("_score"))
    joined = rows.join(best, ["_block", "_text"], "left")
    return joined.select(
        *incoming.columns,
        F.col("_ref").alias(ref if ref not in incoming.columns else f"matched_{ref}"),
        F.coalesce("_score", F.lit(1.0)).alias("score"),
        F.when(F.col("_ref").isNotNull(), "probabilistic").otherwise("new").alias("method"),
    )
