"""Ranked lexical search: item vocabulary tiles times document impact tiles, as dense products in float64.

A document is reduced to the counts of the terms that items have, stored once. Impacts of a
tile of documents over a tile of that vocabulary form one matrix, the weights of the same
terms for a tile of items the other; BLAS multiplies them. All entries are whole numbers and
a vocabulary tile is so narrow that no partial sum reaches 2**53, so products in float64 are
exact in any order of summation; tiles are added up in 64-bit integers. A task keeps the best
of each item with ties settled by id, and the tasks' best are ranked by item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vitalweave.functions.groups import top_n_per_key
from vitalweave.llm.common import as_bytes, map_texts, stored, worker_value
from vitalweave.llm.decontaminate import WORD_BYTES

BEST = 50
#: Items of a block have this many bytes together, at most, unless one alone has more; each block is one pass over the documents.
BLOCK_BYTES = 1 << 20
#: Documents, terms and items of a tile, at most.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 512, 2048, 512
#: Tiles of weights that a worker keeps, of 8 MB each at most.
KEPT_TILES = 4
#: A text is split into words in parts of about so many bytes.
PART_BYTES = 4 << 20
#: An impact is below a million: 10**9 * tf div (1000 * tf + 20 * m) with m of 50 or more.
MOST_IMPACT = 1_000_000
EXACT = 1 << 53


def count_terms(text: bytes | None, terms: dict[bytes, int]) -> tuple[int, list[tuple[int, int]]]:
    """Number of all terms of a UTF-8 text, and (number, occurrences) of those listed in ``terms``, ascending."""
    if not text:
        return 0, []
    plain = text.translate(WORD_BYTES)
    n, at, counts = 0, 0, Counter()
    while at < len(plain):
        end = plain.find(b" ", at + PART_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        n, at = n + len(words), end
        part = Counter(words)
        for w in terms.keys() & part.keys():
            counts[terms[w]] += part[w]
    return n, sorted(counts.items())


def weight(n_docs: int, found: int) -> int:
    """Weight of a term that ``found`` of ``n_docs`` documents hold."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * found + 1)))


class Block:
    """Items of a block, by the numbers of their terms in the block's vocabulary."""

    def __init__(self, texts: Sequence[bytes]):
        found = [set(t.translate(WORD_BYTES).split()) for t in texts]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        #: Pairs (term, item) in the order of the terms.
        pairs = sorted((self.terms[t], item) for item, own in enumerate(found) for t in own)
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)
        self.items = len(texts)


class Scorer:
    """Scores of document tiles for all items of a block."""

    def __init__(self, pairs: np.ndarray, items: int, weights: np.ndarray, n_docs: int, n_terms: int):
        self.pairs, self.items, self.weights, self.n_docs, self.n_terms = pairs, items, weights, n_docs, n_terms
        self.width = max(1, min(TILE_TERMS, (EXACT - 1) // (MOST_IMPACT * max(1, int(weights.max(initial=1))))))
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def tile(self, v: int, i: int) -> np.ndarray:
        """Weights of the terms of vocabulary tile ``v`` for the items of tile ``i``, zero where an item lacks the term."""
        made = self.kept.get((v, i))
        if made is None:
            lo, hi = np.searchsorted(self.pairs[:, 0], (v * self.width, (v + 1) * self.width))
            term, item = self.pairs[lo:hi].T
            own = item // TILE_ITEMS == i
            made = np.zeros((min(self.width, len(self.weights) - v * self.width), min(TILE_ITEMS, self.items - i * TILE_ITEMS)))
            made[term[own] - v * self.width, item[own] - i * TILE_ITEMS] = self.weights[term[own]]
            if len(self.kept) >= KEPT_TILES:
                self.kept.pop(next(iter(self.kept)))
            self.kept[v, i] = made
        return made

    def scores(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """int64 scores of documents by items; ``ids`` and ``tfs`` hold ``sizes`` entries for each document."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = (10**9 * tfs) // (1000 * tfs + 20 * m[doc])
        total = np.zeros((len(n), self.items), np.int64)
        tile = ids // self.width
        order = np.argsort(tile, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1) if len(order) else []:
            v = int(tile[part[0]])
            # Only terms that occur in these documents take up columns.
            present, column = np.unique(ids[part] - v * self.width, return_inverse=True)
            impacts = np.zeros((len(n), len(present)))
            impacts[doc[part], column] = impact[part]
            for i in range(-(-self.items // TILE_ITEMS)):
                total[:, i * TILE_ITEMS : (i + 1) * TILE_ITEMS] += (impacts @ self.tile(v, i)[present]).astype(np.int64)
        return total


class Best:
    """The ``k`` best documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        # A score equal to the last one kept may still win by its id.
        doc, item = np.nonzero(scores >= self.least)
        rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[doc, item], ids[doc], null[doc]))]
        item, score, own, missing = rows
        order = np.lexsort((own, missing, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.rows = [x[order] for x in rows]
        full = rank == self.k - 1
        self.least[item[full]] = rows[1][order][np.flatnonzero(full[rank < self.k])]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the items in blocks of bounded size, of which the driver holds one at a time."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    ids, texts, size = [], [], 0
    for row in rows.filter("text IS NOT NULL").toLocalIterator():
        if texts and size + len(row.text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item)
        texts.append(bytes(row.text))
        size += len(row.text)
    if texts:
        yield ids, texts


def count_block(docs: DataFrame, terms: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """doc_id, the number n of all terms, and the numbers (ids) and occurrences (tfs) of the listed ones, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(list(terms))

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        known = worker_value(shared, lambda listed: {t: i for i, t in enumerate(listed)})
        found = [count_terms(t, known) for t in as_bytes(columns[0])]
        parts = [[[x[part] for x in own] for _, own in found] for part in (0, 1)]
        return [pa.array([n for n, _ in found], pa.int64()), *(pa.array(p, pa.list_(pa.int32())) for p in parts)]

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return map_texts(rows, ["doc_id"], [F.col("_text")], "n long, ids array<int>, tfs array<int>", work)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best rows of ``docs`` for each row of ``items``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. All
    documents count in the statistics and are scored; only positive scores are returned,
    all of them if there are fewer than ``k``. Equal scores go by ascending id, null ids last.
    Null and empty texts have no terms; an item without terms has no rows. Repeated rows of
    either table are documents or items of their own, and a null item_id is a label like any other.
    Other columns are not read, so their names cannot clash. Empty tables give no rows.

    A block of items has at most ``block_bytes``, which bounds its vocabulary, what is broadcast
    and what the driver holds. Of a block, each document is stored as its counts of that
    vocabulary, and a task sends on at most ``k`` rows for each item.
    """
    spark = docs.sparkSession
    label = StructField("item_id", items.schema[item_id].dataType)
    parts = []
    for ids, texts in _blocks(items, item_id, item_text, block_bytes):
        block = Block(texts)
        if not block.terms:
            continue
        counted = stored(count_block(docs, block.terms, text, doc_id))
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms:
            break
        found = np.zeros(len(block.terms), np.int64)
        for term, holding in counted.select(F.explode("ids").alias("term")).groupBy("term").count().collect():
            found[term] = holding
        weights = np.array([weight(n_docs, int(x)) for x in found], np.int64)
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("_item", IntegerType()), label]))
        ranked = _ranked(counted, (block.pairs, block.items, weights, n_docs, n_terms), k)
        parts.append(ranked.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], StructType([label])).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _ranked(counted: DataFrame, block: tuple, k: int) -> DataFrame:
    """_item (the item's place in its block), rank, doc_id and score of the best of the counted documents."""
    shared = counted.sparkSession.sparkContext.broadcast(block)
    names = ["_item", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_value(shared, lambda x: Scorer(*x))
        best = Best(scorer.items, k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                own, n, terms, tfs = batch.slice(start, TILE_DOCS).columns
                sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
                scores = scorer.scores(n.to_numpy(zero_copy_only=False), sizes, *flat)
                best.add(scores, pc.fill_null(own, 0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False))
        item, score, own, null = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(own, pa.int64(), mask=null), pa.array(score, pa.int64())], names=names)

    found = counted.mapInArrow(run, "_item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(*order))
    return top_n_per_key(found, ["_item"], order, k).withColumn("rank", rank)
