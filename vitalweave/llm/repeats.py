"""Repeated passages by a sparse suffix array.

Of all suffixes of the corpus, those at minimisers are kept: of each 35 consecutive runs
of 16 words, the one with the smallest hash. Equal passages of 50 words choose equal
places, so each of them holds the start of a kept suffix, 16 words of which are inside.
The suffixes are sorted by these words over all partitions, and neighbours that differ
from both sides go. Around each one left, the passages of 50 words that chose it are
sorted in the same way; those with an equal neighbour are repeats, and consecutive ones
extend them to the left and to the right, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.llm.common import as_bytes, map_texts, stored, worker_value
from vitalweave.llm.hashing import SPACE_WORDS, Powers, hash_words, run_hashes

#: Words of the shortest repeat that is reported.
PASSAGE = 50
#: Words of a suffix that choose and sort it first.
RUN = 16
#: Bytes of positions that are sent to all executors at most; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def minimisers(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive runs the place of the smallest, the leftmost of equal ones."""
    count = len(runs) - width + 1
    if count < 1:
        return np.zeros(0, np.int64)
    # Smallest values of blocks that double in length; two of them cover a window.
    best, at, size = runs, np.arange(len(runs)), 1
    while size * 2 <= width:
        later = best[size:] < best[:-size]
        best, at = np.where(later, best[size:], best[:-size]), np.where(later, at[size:], at[:-size])
        size *= 2
    shift = width - size
    left, right = best[:count], best[shift : shift + count]
    return np.where(right < left, at[shift : shift + count], at[:count])


def _node(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _with_equal_neighbour(rows: DataFrame, key: str, order: Sequence[str], out: Sequence[str]) -> DataFrame:
    """The rows whose ``key`` another row has too, by sorting over all partitions and comparing neighbours.

    A frequent key is spread over partitions by the rest of the order. The first and the last row of a
    partition stay in any case, as their neighbour may be in another one; they have 0 in the
    column ``sure`` unless a neighbour is equal. Rows equal in all of ``order`` are one row.
    """
    names = [key, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: np.ndarray | None = None  # the last row so far
        first, sure = True, False  # it is the first of all; it has an equal neighbour
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if before is not None:
                table = np.concatenate((before, table))
            fresh = np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1)))
            table = table[fresh]
            equal = table[1:, 0] == table[:-1, 0]
            known = np.concatenate(([sure], equal))
            known[:-1] |= equal
            keep = known.copy()
            keep[0] |= first
            if len(table) > 1:
                yield from emit(table[:-1][keep[:-1]], known[:-1][keep[:-1]])
                first = False
            before, sure = table[-1:], bool(known[-1])
        if before is not None:
            yield from emit(before, np.array([sure]))

    def emit(table: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(table):
            yield pa.RecordBatch.from_arrays([*[pa.array(table[:, names.index(c)]) for c in out], pa.array(sure.astype(np.int64))], names=[*out, "sure"])

    return rows.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(run, ", ".join(f"{c} long" for c in (*out, "sure")))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, run_size: int = RUN) -> DataFrame:
    """(doc_id, n_words, first, end): the longest spans of words all of whose ``passage``-word passages occur elsewhere too.

    Words are separated by white space and compared without the case of A-Z, by 64-bit
    hashes. A word belongs to a span exactly if some passage of ``passage`` words that holds it
    occurs twice or more in the corpus, in another document or at another place of the
    same one. Documents that are copies of each other repeat as a whole. Null, empty and
    shorter texts have no spans; of repeated rows, each has its spans.
    """
    width = passage - run_size + 1
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    seen: set[int] = set()
    shared = context.broadcast(passage)

    def suffixes(columns: list[pa.Array]) -> list[pa.Array]:
        words, bounds = hash_words(as_bytes(columns[0]), SPACE_WORDS, worker_value(shared, lambda _: Powers()))
        nodes, sizes, places, hashes = [], [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = words[a:b]
            node = _node(own) if b - a >= passage else None
            nodes.append(node)
            sizes.append(b - a)
            if node is None or node in seen:
                places.append([])
                hashes.append([])
                continue
            seen.add(node)
            runs = run_hashes(own, run_size)
            chosen = np.unique(minimisers(runs, width))
            places.append(chosen)
            hashes.append(runs[chosen].view(np.int64))
        return [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))]

    rows = stored(map_texts(plain, ["doc_id"], [F.col("text")], "node long, n_words long, places array<long>, runs array<long>", suffixes))
    whole = rows.filter("node IS NOT NULL")
    kept = whole.select("node", F.explode(F.arrays_zip("places", "runs")).alias("x")).select("node", F.col("x.places").alias("place"), F.col("x.runs").alias("run"))
    live = _with_equal_neighbour(kept, "run", ["node", "place"], ["node", "place"])
    reps = whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    live = stored(live.groupBy("node").agg(F.collect_list("place").alias("places")).join(reps, "node").select("node", "rep", "places"))
    size = live.agg(F.sum(24 + 8 * F.size("places"))).first()[0] or 0
    wanted = F.broadcast(live) if size <= BROADCAST_BYTES else live

    def passages(columns: list[pa.Array]) -> list[pa.Array]:
        words, bounds = hash_words(as_bytes(columns[0]), SPACE_WORDS, worker_value(shared, lambda _: Powers()))
        nodes, chosen = columns[1].to_pylist(), [np.asarray(x.values) for x in columns[2]]
        starts, hashes = [], []
        for node, live_places, a, b in zip(nodes, chosen, bounds[:-1], bounds[1:]):
            own = words[a:b]
            if b - a < passage or _node(own) != node:
                starts.append([])
                hashes.append([])
                continue
            at = minimisers(run_hashes(own, run_size), width)
            near = np.flatnonzero(np.isin(at, live_places))
            starts.append(near)
            hashes.append(run_hashes(own, passage)[near].view(np.int64))
        return [pa.array(starts, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))]

    found = plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))
    found = map_texts(found, ["node"], [F.col("text"), F.col("node"), F.col("places")], "starts array<long>, hashes array<long>", passages)
    near = found.select("node", F.explode(F.arrays_zip("starts", "hashes")).alias("x")).select("node", F.col("x.starts").alias("start"), F.col("x.hashes").alias("hash"))
    equal = stored(_with_equal_neighbour(near, "hash", ["node", "start"], ["hash", "node", "start"]))
    # At most two rows of a partition are not sure; they count if another row has their hash.
    unsure = equal.filter("sure = 0")
    theirs = equal.join(F.broadcast(unsure.select("hash").distinct()), "hash").groupBy("hash").agg(F.min(F.struct("node", "start")).alias("_low"), F.max(F.struct("node", "start")).alias("_high"))
    twice = unsure.join(theirs.filter("_low < _high").select("hash"), "hash", "left_semi")
    starts = equal.filter("sure = 1").unionByName(twice).groupBy("node").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    copied = reps.filter("copies > 1").select("node", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end"))).alias("spans"))

    def extend(columns: list[pa.Array]) -> list[pa.Array]:
        spans = []
        for x in columns[0]:
            at = np.asarray(x.values)
            breaks = np.flatnonzero(np.diff(at) > passage) + 1
            spans.append([{"first": int(p[0]), "end": int(p[-1]) + passage} for p in np.split(at, breaks)])
        return [pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]

    extended = map_texts(starts, ["node"], [F.col("starts")], "spans array<struct<first:long,end:long>>", extend, sized=False)
    spans = copied.unionByName(extended.join(copied.select("node"), "node", "left_anti"))
    out = whole.select("doc_id", "node", "n_words").join(spans, "node")
    return out.select("doc_id", "n_words", F.inline("spans"))
