"""Helpers of the text operators: bounded pieces of Arrow batches, values built once per Python worker."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalweave.session import cut_lineage

PIECE_BYTES = 4 << 20


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def as_text(value: bytes | None) -> str:
    """Text of UTF-8 bytes; null is the empty text and a broken sequence the replacement character."""
    return "" if value is None else value.decode("utf-8", "replace")


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, as batches with about ``limit`` bytes in the text column; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        for start, end in zip(starts[:-1], starts[1:]):
            yield batch.slice(start, end - start)


def worker_value(shared, build: Callable):
    """``build`` of a broadcast value, made once in each Python worker and kept with the broadcast."""
    made = getattr(shared, "_made", None)
    if made is None:
        made = shared._made = build(shared.value)
    return made


def give_back() -> None:
    """Return memory that is free, but still held by the allocators, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    added: str,
    work: Callable[[list[pa.Array]], list[pa.Array]],
    sized: bool = True,
    ended: Callable[[], None] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns ``added`` that ``work`` makes of the ``inputs``, batch by batch.

    ``work`` gets the arrays of a batch and returns one array for each added column, with as
    many rows. Batches are cut by the bytes of the first input, or with ``sized`` off, by rows. After
    the last one, ``ended`` runs and the worker gives free memory back: workers are used again. Kept
    columns travel under other names, so that no name can clash; one that is also added is
    replaced.
    """
    fields = StructType.fromDDL(added)
    keep = [c for c in keep if c not in fields.names]
    place = len(keep)
    rows = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[c.alias(f"_i{i}") for i, c in enumerate(inputs)])
    schema = rows.select(rows.columns[:place]).schema
    for i, field in enumerate(fields):
        schema = schema.add(f"_a{i}", field.dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place) if sized else (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *work(batch.columns[place:])], names=names)
        if ended is not None:
            ended()
        give_back()

    return rows.mapInArrow(run, schema).toDF(*keep, *fields.names)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder in ``spark.checkpoint.dir``; a lost executor does not lose them.

    What was shuffled to make them is removed as soon as they are written.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        # The setting is read when a table is put together, so it is put together again.
        return cut_lineage(df.select("*"))
    finally:
        if before is None:
            conf.unset(FREE_SHUFFLES)
        else:
            conf.set(FREE_SHUFFLES, before)
