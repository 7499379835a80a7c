"""Columns that are computed once and then only read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with the given columns added or replaced, each evaluated a single time per row.

    The optimizer merges neighbouring projections and moves filters below them, and so
    repeats an expensive expression wherever its column is used. It does not do so
    across a generator, so the columns are opened from a one-element array here.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))
