"""Logistic risk model: dataset, training, evaluation, batch scoring and the job registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key
from vitalweave.functions.scalars import json_text, number, sigmoid, text_number

# Training defaults, loss guard and the answer given when scoring is impossible.
TRAINING_ROWS = 1_000
LABEL_THRESHOLD = 120.0
EPOCHS, LEARNING_RATE = 200, 0.01
LOSS_GUARD = 1e-9
DEFAULT_MODEL = "risk-score"
FALLBACK_SCORE, FALLBACK_CATEGORY, FALLBACK_CONFIDENCE = 0.75, "high_risk", 0.85
JOB_ROWS = 10


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    bias: float
    coefficients: tuple[float, ...]


class NoTrainingData(ValueError):
    """The dataset holds no numeric row."""


def training_rows(facts: DataFrame, patients: DataFrame | None = None, n: int | None = TRAINING_ROWS) -> DataFrame:
    """Newest ``n`` facts, of the listed patients when given; ``None`` keeps all."""
    rows = facts if patients is None else facts.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    return rows if n is None else rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def build_dataset(rows: DataFrame, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """(value, label) for the rows with a numeric value; the label is 1 at or above the threshold."""
    numbers = rows.select(number(rows, "value").alias("value")).filter(F.col("value").isNotNull())
    return numbers.withColumn("label", F.when(F.col("value") >= threshold, 1.0).otherwise(0.0))


def _margin(features: Sequence[str], bias: float, coefficients: Sequence[float]) -> Column:
    total = F.lit(float(bias))
    for name, weight in zip(features, coefficients):
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def fit_logistic(
    df: DataFrame,
    features: Sequence[str] = ("value",),
    label: str = "label",
    epochs: int = EPOCHS,
    rate: float = LEARNING_RATE,
) -> LogisticModel:
    """Full-batch gradient descent from zero.

    Equal samples collapse to one row with a count and stay in executor storage
    (spilling to disk, rebuilt from the input when an executor is lost). Each epoch
    is one aggregate; the driver sees only the gradient, one number per weight.
    """
    if epochs < 1 or rate <= 0:
        raise ValueError("epochs and rate must be positive")
    samples = df.groupBy(*features, label).agg(F.count("*").cast("double").alias("_n"))
    samples = samples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = samples.agg(F.sum("_n")).first()[0]
        if not total:
            raise NoTrainingData("no numeric data available for training")
        bias, weights = 0.0, [0.0] * len(features)
        for _ in range(epochs):
            error = (sigmoid(_margin(features, bias, weights)) - F.col(label)) * F.col("_n")
            gradient = samples.select(error.alias("_e"), *features).agg(
                F.sum("_e"), *[F.sum(F.col("_e") * F.col(name)) for name in features]
            ).first()
            bias -= rate * gradient[0] / total
            weights = [w - rate * g / total for w, g in zip(weights, gradient[1:])]
        return LogisticModel(tuple(features), bias, tuple(weights))
    finally:
        samples.unpersist()


def evaluate_logistic(df: DataFrame, model: LogisticModel, label: str = "label") -> DataFrame:
    """Samples, mean log loss and accuracy at one half, in one pass."""
    p, y = F.col("_p"), F.col(label)
    loss = -y * F.log(p + LOSS_GUARD) - (1 - y) * F.log(1 - p + LOSS_GUARD)
    hit = F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)
    scored = df.withColumn("_p", sigmoid(_margin(model.features, model.bias, model.coefficients)))
    return scored.agg(F.count("*").alias("samples"), F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy"))


def model_rows(df: DataFrame, model: LogisticModel, model_type: str, job_id: str, created_at: str) -> DataFrame:
    """The model as a registry row; ``df`` only supplies the session."""
    return df.sparkSession.range(1).select(
        F.lit(job_id).alias("job_id"),
        F.lit(model_type).alias("model_type"),
        F.lit("logistic_regression").alias("algorithm"),
        F.array(*[F.lit(f) for f in model.features]).alias("feature_names"),
        F.lit(model.bias).alias("bias"),
        F.array(*[F.lit(c) for c in model.coefficients]).alias("coefficients"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def to_model(row) -> LogisticModel:
    return LogisticModel(tuple(row["feature_names"]), row["bias"], tuple(row["coefficients"]))


def merge_features(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with ``numeric``: stored and request features, the request winning, numbers only.

    Both sides hold maps of text; ``stored`` has one row per entity.
    """
    known = stored.select("entity_id", F.col("features").alias("_stored"))
    empty = F.create_map().cast("map<string,string>")
    joined = requests.join(known, "entity_id", "left")
    given = F.coalesce(F.col("features"), empty)
    merged = F.map_zip_with(
        F.coalesce(F.col("_stored"), empty),
        given,
        lambda k, old, new: F.when(F.map_contains_key(given, k), new).otherwise(old),
    )
    numbers = F.map_filter(F.transform_values(merged, lambda _, v: text_number(v)), lambda _, v: v.isNotNull())
    return joined.withColumn("numeric", numbers).drop("_stored")


def score(df: DataFrame, model: LogisticModel, numeric: str = "numeric") -> DataFrame:
    """Adds ``risk_score``, null when a feature of the model is missing, and ``error`` saying which."""
    values = {name: F.try_element_at(F.col(numeric), F.lit(name)) for name in model.features}
    margin = F.lit(model.bias)
    for name, weight in zip(model.features, model.coefficients):
        margin = margin + F.lit(weight) * values[name]
    gaps = F.coalesce(*[F.when(v.isNull(), F.lit(f"missing feature {n}")) for n, v in values.items()])
    if not model.features:
        margin, gaps = F.lit(None).cast("double"), F.lit("artifact missing feature names")
    return df.withColumns({"risk_score": sigmoid(margin), "error": gaps})


def score_or_default(df: DataFrame, model: LogisticModel, numeric: str = "numeric") -> DataFrame:
    """Scores with the fixed answer, category and confidence where scoring is impossible."""
    scored = score(df, model, numeric)
    missing = F.col("error").isNotNull()
    return scored.select(
        *df.columns,
        F.when(missing, F.lit(FALLBACK_SCORE)).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(missing, F.lit(FALLBACK_CATEGORY)).alias("category"),
        F.when(missing, F.lit(FALLBACK_CONFIDENCE)).otherwise(F.col("risk_score")).alias("confidence"),
        missing.alias("is_fallback"),
    )


def prediction_log(df: DataFrame, latency_ms: Column, created_at: Column, model_name: str = DEFAULT_MODEL) -> DataFrame:
    """Log rows for scored requests."""
    response = F.struct("risk_score", "category")
    return df.select(
        F.col("request_id").alias("id"),
        F.col("entity_id").alias("patient_id"),
        F.coalesce(F.nullif(F.col("model_name"), F.lit("")), F.lit(model_name)).alias("model_name"),
        F.to_json("numeric").alias("request"),
        F.to_json(response).alias("response"),
        latency_ms.alias("latency_ms"),
        "confidence",
        created_at.alias("created_at"),
    )


def current_models(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Promoted job of each model type: newest promotion state per job, then newest promoted job per type.

    ``events`` has (job_id, promoted, at, seq); ``jobs`` has (id, model_type).
    """
    state = latest_per_key(events.select("job_id", "promoted", "at", "seq"), ["job_id"], ["at", "seq"])
    live = state.filter("promoted").join(jobs.select(F.col("id").alias("job_id"), "model_type"), "job_id")
    return latest_per_key(live, ["model_type"], ["at", "job_id"]).select("model_type", "job_id", F.col("at").alias("promoted_at"))


def job_summaries(jobs: DataFrame, n: int = JOB_ROWS) -> DataFrame:
    """Newest jobs with accuracy and loss read from the metrics document; blank or absent is null."""
    newest = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.select(
        "id",
        "model_type",
        "status",
        "created_at",
        text_number(json_text("metrics", "$.accuracy")).alias("accuracy"),
        text_number(json_text("metrics", "$.loss")).alias("loss"),
    )


def job_kpis(jobs: DataFrame) -> DataFrame:
    """Promoted and running jobs and mean accuracy (0 when no job reports one)."""
    accuracy = text_number(json_text("metrics", "$.accuracy"))
    return jobs.agg(
        F.count_if("promoted").alias("promoted"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.coalesce(F.avg(accuracy), F.lit(0.0)).alias("mean_accuracy"),
    )
