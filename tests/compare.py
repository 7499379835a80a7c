"""Runs a plan on Spark and its statement on DuckDB and compares columns, types and values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _kind(values: pd.Series) -> str:
    known = [v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)) and v is not pd.NaT]
    kinds = {type(v).__name__.replace("int64", "int").replace("int32", "int32").replace("float64", "float").replace("bool_", "bool") for v in known}
    return ",".join(sorted(kinds))


def _whole(values: pd.Series) -> pd.Series:
    """A column of whole numbers with gaps as such; pandas makes floats of it on the way from Spark."""
    if values.dtype == "float64" and values.isna().any() and (values.dropna() % 1 == 0).all():
        return values.astype("Int64")
    return values


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(float(f"{value:.9g}"))
    return str(value)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> list[str]:
    """Empty when both results are equal, row order aside."""
    found = []
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return [f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"]
    columns = sorted(spark_rows.columns)
    for name in columns:
        if str(sql_rows[name].dtype) == "Int64":
            spark_rows = spark_rows.assign(**{name: _whole(spark_rows[name])})
        left, right = str(spark_rows[name].dtype), str(sql_rows[name].dtype)
        if left != right and not (left.startswith("datetime") and right.startswith("datetime")):
            if {left, right} != {"object", "str"}:
                found.append(f"type of {name}: {left} and {right}")
    if len(spark_rows) != len(sql_rows):
        found.append(f"rows {len(spark_rows)} and {len(sql_rows)}")
    left = sorted(tuple(_cell(v) for v in row) for row in spark_rows[columns].itertuples(index=False))
    right = sorted(tuple(_cell(v) for v in row) for row in sql_rows[columns].itertuples(index=False))
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        found.append(f"values of {columns}: {only_left} and {only_right}")
    return found
