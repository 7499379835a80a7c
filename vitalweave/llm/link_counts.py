"""How many links each document has in the similarity join, counted exactly in tiles of its components.

Components come from spanning links. All links lie inside components, so each component is
multiplied once more with whole rows instead of first columns: its rows go in tiles of
bounded weight, each pair of tiles of like row sizes to a task of its own, whose product holds
the overlaps of all their pairs. Only a number for each row leaves the task, never a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.llm import ngram_join
from vitalweave.llm.common import stored
from vitalweave.llm.components import components
from vitalweave.llm.frequent import spread_join

#: N-grams of the rows of a tile together, about (8 bytes each); a row of more is a tile of its own, about.
TILE_ENTRIES = 4 << 20
#: Products are summed in 32-bit floats, exact below this; overlaps of larger rows are intersected.
EXACT = 1 << 24


def _linked(rows: pa.Table) -> pa.Table:
    """(node, links) of the rows of a pair of tiles: the documents of the rows of the other tile (or the same) that link with them."""
    left, right, product, size, _ = ngram_join._tile(rows)
    copies, found = rows["copies"].to_numpy(), np.zeros(len(size), np.int64)
    inside = rows["i"][0].as_py() == rows["j"][0].as_py()
    if inside or left is not right:  # else the other tile has no rows
        for start in range(0, len(left), 256):
            block = left[start : start + 256]
            x, y = size[block][:, None], size[right][None, :]
            overlap = product[start : start + 256].astype(np.int64)
            for a, b in zip(*np.nonzero(np.minimum(x, y) >= EXACT)):
                sets = [np.asarray(rows["prefix"][int(k)].values) for k in (block[a], right[b])]
                overlap[a, b] = len(np.intersect1d(*sets, assume_unique=True))
            link = (100 * overlap >= ngram_join.PERCENT * (x + y - overlap)) & (block[:, None] != right[None, :])
            found[block] += link @ copies[right]
            if not inside:
                found[right] += copies[block] @ link
    return pa.table({"node": rows["node"], "links": pa.array(found)})


def jaccard_degrees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of ``docs``.

    The first three are those of :func:`ngram_join.jaccard_components`. n_links is the number of other
    rows whose set is similar enough, equal ones included: no link is left out, whatever the
    size of the group. Repeated rows and rows with null ids count as rows of their own. A null
    text and one without words have no links; an empty table gives no rows.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows, nodes, links = ngram_join.jaccard_links(plain)
    copies = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    known = stored(nodes.join(copies, "node").join(components(links), "node", "left"))
    several = known.filter("label IS NOT NULL")
    members = several.select("node", "copies", F.col("n").alias("size"), F.col("label").alias("family"), F.col("node").alias("label"))
    sets = ngram_join._sets(plain, "doc_id", "text", stored(several.select("node", "rep")))
    weight = 1 + F.col("size") * F.lit(ngram_join.TILE_ROWS / TILE_ENTRIES)
    tiles = ngram_join._tiles(stored(members), sets.withColumnRenamed("runs", "prefix"), weight)
    counted = tiles.groupBy("family", "i", "j").applyInArrow(_linked, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    smallest = known.groupBy(F.coalesce("label", "node").alias("family")).agg(F.min("rep").alias("component_id"))
    total = F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1
    placed = known.withColumn("family", F.coalesce("label", "node")).join(smallest, "family").join(counted, "node", "left")
    of = stored(placed.select("node", "component_id", total.alias("n_links")))
    out = spread_join(rows, of, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )
