"""Reading relational tables and writing the fact table, exports and model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key
from vitalweave.functions.scalars import export_text


MAX_FILE_ROWS = 5_000_000


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One Parquet table below ``path``."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_relational(spark: SparkSession, url: str, table: str, **options: object) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_facts(df: DataFrame, path: str, mode: str) -> None:
    """Write facts by resource type and day, so that cohort filters prune files.

    The rebalance hint lets adaptive execution size the writing tasks: a busy type
    and day is split over several of them, small ones share one.
    """
    layout = ["resource_type", "event_date"]
    (
        df.withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", *layout)
        .sortWithinPartitions(*layout, "patient_id")
        .write.mode(mode)
        .option("maxRecordsPerFile", MAX_FILE_ROWS)
        .partitionBy(*layout)
        .parquet(path)
    )


def append_facts(df: DataFrame, path: str) -> None:
    write_facts(df, path, "append")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every field as CSV text; a field the table lacks becomes empty text."""
    return df.select(
        *[(export_text(df, f) if f in df.columns else F.lit("")).alias(f) for f in fields]
    )


def export_cohort(df: DataFrame, fields: Sequence[str], path: str, limit: int | None = None) -> None:
    """Distributed CSV export with a header in each part file; with a limit, of the newest rows."""
    if limit is not None:
        df = df.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    export_rows(df, fields).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


MODEL_SCHEMA = (
    "job_id string, model_type string, algorithm string, feature_names array<string>, "
    "bias double, coefficients array<double>, created_at timestamp_ntz"
)


def save_model(models: DataFrame, path: str) -> None:
    """Append model rows; the newest row of a type is its current artifact."""
    models.select("job_id", "model_type", "algorithm", "feature_names", "bias", "coefficients", "created_at").write.mode(
        "append"
    ).parquet(path)


def latest_models(models: DataFrame) -> DataFrame:
    return latest_per_key(models, ["model_type"], ["created_at", "job_id"])


def load_latest_model(spark: SparkSession, path: str, model_type: str) -> DataFrame:
    """The newest model row of one type, as a one-row table."""
    return latest_models(spark.read.schema(MODEL_SCHEMA).parquet(path).filter(F.col("model_type") == model_type))
