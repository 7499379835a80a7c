"""Registry of named plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.sources import fixtures


class Tables:
    """Given and derived tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, *tables: str) -> Callable:
    """Register a plan; ``tables`` are the derived tables its SQL statement needs."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        text = sql
        if sql is not None and tables:
            ctes = fixtures.with_clause(*tables)
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ctes, body = "WITH RECURSIVE " + ctes[5:], "WITH " + body[15:]
            text = f"{ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{ctes}\n{body}"
        PLANS[name] = Plan(name, build, text)
        return build

    return register


def clock(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)
