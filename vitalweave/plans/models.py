"""Feature store, training, scoring and the model registry."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.operators import features as X
from vitalweave.operators import model as T
from vitalweave.operators.model import LogisticModel
from vitalweave.plans.registry import Tables, clock, plan, rounded
from vitalweave.session import shared_dir
from vitalweave.sources.tables import latest_models, load_latest_model, save_model

AS_OF = "2024-01-30 12:00:00"
DAY = timedelta(days=1)
MODEL = LogisticModel(("value",), -1.2, (0.01,))
LATEST_SQL = """SELECT entity_id, max(version) AS version, arg_max_null(concept, row(created_at, version)) AS concept,
    arg_max_null(value, row(created_at, version)) AS value, max(created_at) AS created_at FROM offline_features"""
ALIVE_SQL = f"created_at > TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY AND created_at <= TIMESTAMP '{AS_OF}'"


def stored(t: Tables) -> DataFrame:
    """Stored features as maps of text."""
    values = F.create_map(F.lit("concept"), F.col("concept"), F.lit("value"), F.col("value").cast("string"))
    return t["offline_features"].select(
        "entity_id", "version", F.map_filter(values, lambda _, v: v.isNotNull()).alias("features"), "created_at", "source_id"
    )


def flat(df: DataFrame) -> DataFrame:
    return df.select(
        "entity_id",
        "version",
        F.col("features")["concept"].alias("concept"),
        F.col("features")["value"].cast("double").alias("value"),
        "created_at",
    )


@plan(
    "f1_event_features",
    """SELECT master_id AS entity_id, epoch_us(timestamp) AS version, lower(resource_type) AS resource_type,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS event_time, CAST(value AS VARCHAR) AS value, unit, concept FROM facts""",
    "facts",
)
def _(t: Tables):
    names = ["resource_type", "event_time", "value", "unit", "concept"]
    rows = X.event_features(t["facts"])
    return rows.select("entity_id", "version", *[F.col("features")[n].alias(n) for n in names])


@plan(
    "f2_append_features",
    """WITH days AS (SELECT patient_id AS entity_id, CAST(extract(DAY FROM timestamp) AS INTEGER) AS version, resource_type, concept, timestamp, id FROM facts),
       first AS (SELECT *, row_number() OVER (PARTITION BY entity_id, version ORDER BY timestamp, id) AS n FROM days)
       SELECT entity_id, version, concept, id AS source_id FROM first f WHERE n = 1
       AND NOT EXISTS (SELECT 1 FROM days d WHERE d.resource_type = 'Condition' AND d.entity_id = f.entity_id AND d.version = f.version)""",
    "facts",
)
def _(t: Tables):
    rows = t["facts"].select(
        F.col("patient_id").alias("entity_id"),
        F.dayofmonth("timestamp").alias("version"),
        F.create_map(F.lit("concept"), F.col("concept")).alias("features"),
        F.col("timestamp").alias("created_at"),
        F.col("id").alias("source_id"),
        "resource_type",
    )
    existing = X.append_features(rows.filter("resource_type = 'Condition'"))
    added = X.append_features(rows, existing)
    return added.select("entity_id", "version", F.col("features")["concept"].alias("concept"), "source_id")


@plan("f3_online_features", f"{LATEST_SQL} WHERE {ALIVE_SQL} GROUP BY entity_id", "offline_features")
def _(t: Tables):
    return flat(X.online_features(stored(t), clock(AS_OF), DAY))


@plan(
    "f4_feature_views",
    """SELECT concat(entity_id, ':', CAST(version AS VARCHAR)) AS id, concept, created_at FROM offline_features
       WHERE concept = 'heart-rate' ORDER BY created_at DESC, concat(entity_id, ':', CAST(version AS VARCHAR)) DESC LIMIT 200""",
    "offline_features",
)
def _(t: Tables):
    wanted = t["offline_features"].filter("concept = 'heart-rate'")
    ids = wanted.select(F.concat_ws(":", "entity_id", F.col("version").cast("string")).alias("id"))
    views = X.feature_views(stored(t), ids)
    return views.select("id", F.col("features")["concept"].alias("concept"), "created_at")


@plan("f5_latest_features", f"{LATEST_SQL} GROUP BY entity_id", "offline_features")
def _(t: Tables):
    return flat(X.latest_features(stored(t)))


@plan(
    "f6_resolve_features",
    f"""WITH live AS ({LATEST_SQL} WHERE {ALIVE_SQL} GROUP BY entity_id), old AS ({LATEST_SQL} GROUP BY entity_id)
        SELECT coalesce(live.entity_id, old.entity_id) AS entity_id,
               CASE WHEN live.entity_id IS NOT NULL THEN live.concept ELSE old.concept END AS concept,
               CASE WHEN live.entity_id IS NOT NULL THEN 'online' ELSE 'offline' END AS feature_source
        FROM live FULL JOIN old ON old.entity_id = live.entity_id""",
    "offline_features",
)
def _(t: Tables):
    rows = stored(t)
    found = X.resolve_features(X.online_features(rows, clock(AS_OF), DAY), X.latest_features(rows))
    return found.select("entity_id", F.col("features")["concept"].alias("concept"), "feature_source")


@plan(
    "t1_training_rows",
    """SELECT id, patient_id, value, timestamp FROM facts
       WHERE patient_id IN (SELECT patient_id FROM facts WHERE concept = 'diagnosis-diabetes')
       ORDER BY timestamp DESC, id DESC LIMIT 1000""",
    "facts",
)
def _(t: Tables):
    facts = t["facts"]
    patients = facts.filter("concept = 'diagnosis-diabetes'").select("patient_id")
    return T.training_rows(facts, patients).select("id", "patient_id", "value", "timestamp")


NUMERIC = r"regexp_matches(trim(value), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


@plan(
    "t2_build_dataset",
    f"""WITH x AS (SELECT CASE WHEN {NUMERIC} THEN CAST(trim(value) AS DOUBLE) END AS value FROM mixed_facts)
        SELECT value, CASE WHEN value >= 120 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM x WHERE value IS NOT NULL""",
    "mixed_facts",
)
def _(t: Tables):
    return T.build_dataset(t["mixed_facts"])


def _epoch_sql(i: int) -> str:
    p = "1 / (1 + exp(-(w * x + b)))"
    return (
        f"e{i} AS (SELECT any_value(b) - 0.01 * sum({p} - y) / count(*) AS b, "
        f"any_value(w) - 0.01 * sum(({p} - y) * x) / count(*) AS w FROM samples CROSS JOIN e{i - 1})"
    )


SAMPLES_SQL = "samples AS (SELECT value / 100 AS x, CASE WHEN value >= 120 THEN 1 ELSE 0 END AS y FROM facts WHERE value IS NOT NULL)"


def samples(t: Tables) -> DataFrame:
    """Dataset with the value in hundreds, where three epochs already move the weights."""
    return T.build_dataset(t["facts"]).withColumn("x", F.col("value") / 100)


@plan(
    "t3_fit_logistic",
    f"""WITH {SAMPLES_SQL}, e0 AS (SELECT CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS w),
        {_epoch_sql(1)}, {_epoch_sql(2)}, {_epoch_sql(3)}
        SELECT round(b, 8) AS bias, round(w, 8) AS coefficient FROM e3""",
    "facts",
)
def _(t: Tables):
    model = T.fit_logistic(samples(t), ["x"], epochs=3)
    rows = T.model_rows(t["facts"], model, "risk-score", "job", AS_OF)
    return rows.select(rounded("bias", 8), F.round(F.col("coefficients")[0], 8).alias("coefficient"))


ALL_EPOCHS_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, n AS (SELECT x, y, count(*) AS n FROM samples GROUP BY ALL),
        f AS (SELECT 0 AS e, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS w UNION ALL
              SELECT e + 1, b - 0.01 * sum((1 / (1 + exp(-(w * x + b))) - y) * n) / sum(n), w - 0.01 * sum((1 / (1 + exp(-(w * x + b))) - y) * x * n) / sum(n)
              FROM f CROSS JOIN n WHERE e < {T.EPOCHS} GROUP BY e, b, w)"""


@plan("t3_fit_logistic_full", f"{ALL_EPOCHS_SQL} SELECT round(b, 8) AS bias, round(w, 8) AS coefficient FROM f WHERE e = {T.EPOCHS}", "facts")
def _(t: Tables):
    rows = T.model_rows(t["facts"], T.fit_logistic(samples(t), ["x"]), "risk-score", "job", AS_OF)
    return rows.select(rounded("bias", 8), F.round(F.col("coefficients")[0], 8).alias("coefficient"))


@plan(
    "s7_model_round_trip",
    f"""WITH {SAMPLES_SQL}, e0 AS (SELECT CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS w), {_epoch_sql(1)}, {_epoch_sql(2)}, {_epoch_sql(3)}
        SELECT f.id, round(1 / (1 + exp(-(w * (value / 100) + b))), 8) AS risk_score,
               CASE WHEN value IS NULL THEN 'missing feature x' END AS error FROM facts f CROSS JOIN e3""",
    "facts",
)
def _(t: Tables):
    """Fitted, saved, loaded and scored; an older and another model lie in the same registry."""
    folder = f"{shared_dir(t.spark)}/models-{uuid.uuid4().hex}"
    model = T.fit_logistic(samples(t), ["x"], epochs=3)
    for kind, job, made, fitted in (("risk-score", "old", "2024-01-01 00:00:00", MODEL), ("triage", "other", "2024-03-01 00:00:00", MODEL), ("risk-score", "new", AS_OF, model)):
        save_model(T.model_rows(t["facts"], fitted, kind, job, made), folder)
    loaded = T.to_model(load_latest_model(t.spark, folder, "risk-score").first())
    numeric = F.map_filter(F.create_map(F.lit("x"), F.col("value") / 100), lambda _, v: v.isNotNull())
    return T.score(t["facts"].withColumn("numeric", numeric), loaded).select("id", rounded("risk_score", 8), "error")


@plan(
    "t4_evaluate_logistic",
    """WITH x AS (SELECT 1 / (1 + exp(-(0.01 * value - 1.2))) AS p, CASE WHEN value >= 120 THEN 1 ELSE 0 END AS y FROM facts WHERE value IS NOT NULL)
       SELECT count(*) AS samples, round(avg(-y * ln(p + 1e-9) - (1 - y) * ln(1 - p + 1e-9)), 8) AS loss,
              round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS accuracy FROM x""",
    "facts",
)
def _(t: Tables):
    figures = T.evaluate_logistic(T.build_dataset(t["facts"]), MODEL)
    return figures.select("samples", rounded("loss", 8), rounded("accuracy", 8))


def requests(t: Tables) -> DataFrame:
    """Prediction requests; some bring a value of their own, some a value that is no number."""
    given = (
        F.when(F.col("id") % 3 == 0, F.create_map(F.lit("value"), F.col("latency_ms").cast("string")))
        .when(F.col("id") % 7 == 0, F.create_map(F.lit("value"), F.lit("high")))
        .otherwise(F.create_map(F.lit("age"), F.lit("61")))
    )
    return t["prediction_logs"].select(
        F.col("id").alias("request_id"),
        F.col("patient_id").alias("entity_id"),
        F.when(F.col("id") % 2 == 0, F.col("model_name")).otherwise(F.lit("")).alias("model_name"),
        given.alias("features"),
        "latency_ms",
        "created_at",
    )


MERGED_SQL = f"""WITH old AS ({LATEST_SQL} GROUP BY entity_id),
    merged AS (SELECT p.id AS request_id, p.patient_id AS entity_id, p.latency_ms, p.created_at, p.model_name,
                      CASE WHEN p.id % 3 = 0 THEN p.latency_ms WHEN p.id % 7 = 0 THEN NULL ELSE old.value END AS value,
                      CASE WHEN p.id % 3 <> 0 AND p.id % 7 <> 0 THEN CAST(61 AS DOUBLE) END AS age
               FROM prediction_logs p LEFT JOIN old ON old.entity_id = p.patient_id)
    """
SCORE_SQL = "1 / (1 + exp(-(0.01 * value - 1.2)))"
MODEL_TABLES = ("offline_features", "prediction_logs")


def merged(t: Tables) -> DataFrame:
    return T.merge_features(X.latest_features(stored(t)), requests(t))


@plan(
    "t5_score",
    f"""{MERGED_SQL} SELECT request_id, round({SCORE_SQL}, 10) AS risk_score,
        CASE WHEN value IS NULL THEN 'missing feature value' END AS error FROM merged""",
    *MODEL_TABLES,
)
def _(t: Tables):
    return T.score(merged(t), MODEL).select("request_id", rounded("risk_score", 10), "error")


@plan("t6_merge_features", f"{MERGED_SQL} SELECT request_id, value, age FROM merged", *MODEL_TABLES)
def _(t: Tables):
    return merged(t).select("request_id", F.col("numeric")["value"].alias("value"), F.col("numeric")["age"].alias("age"))


@plan(
    "t7_score_or_default",
    f"""{MERGED_SQL} SELECT request_id, round(CASE WHEN value IS NULL THEN 0.75 ELSE {SCORE_SQL} END, 10) AS risk_score,
        CASE WHEN value IS NULL THEN 'high_risk' END AS category,
        round(CASE WHEN value IS NULL THEN 0.85 ELSE {SCORE_SQL} END, 10) AS confidence, value IS NULL AS is_fallback FROM merged""",
    *MODEL_TABLES,
)
def _(t: Tables):
    rows = T.score_or_default(merged(t), MODEL)
    return rows.select("request_id", rounded("risk_score", 10), "category", rounded("confidence", 10), "is_fallback")


@plan(
    "t8_prediction_log",
    f"""{MERGED_SQL} SELECT request_id AS id, entity_id AS patient_id, CASE WHEN request_id % 2 = 0 THEN model_name ELSE 'risk-score' END AS model_name,
        latency_ms, round(CASE WHEN value IS NULL THEN 0.85 ELSE {SCORE_SQL} END, 10) AS confidence, created_at FROM merged""",
    *MODEL_TABLES,
)
def _(t: Tables):
    log = T.prediction_log(T.score_or_default(merged(t), MODEL), F.col("latency_ms"), F.col("created_at"))
    return log.select("id", "patient_id", "model_name", "latency_ms", rounded("confidence", 10), "created_at")


@plan(
    "s7_latest_models",
    """SELECT model_type, max_by(job_id, row(created_at, job_id)) AS job_id, max_by(bias, row(created_at, job_id)) AS bias,
       max_by(coefficient, row(created_at, job_id)) AS coefficient FROM model_rows GROUP BY model_type""",
    "model_rows",
)
def _(t: Tables):
    models = t["model_rows"].select(
        "job_id",
        "model_type",
        "algorithm",
        F.array(F.lit("value")).alias("feature_names"),
        "bias",
        F.array("coefficient").alias("coefficients"),
        "created_at",
    )
    return latest_models(models).select("model_type", "job_id", "bias", F.col("coefficients")[0].alias("coefficient"))


@plan(
    "t9_current_models",
    """WITH state AS (SELECT job_id, max_by(promoted, row("at", seq)) AS promoted, max("at") AS changed FROM promotions GROUP BY job_id)
       SELECT model_type, max_by(job_id, row(changed, job_id)) AS job_id, max(changed) AS promoted_at
       FROM state JOIN jobs ON jobs.id = state.job_id WHERE state.promoted GROUP BY model_type""",
    "jobs",
    "promotions",
)
def _(t: Tables):
    return T.current_models(t["jobs"], t["promotions"])


ACCURACY_SQL = "TRY_CAST(nullif(metrics ->> '$.accuracy', '') AS DOUBLE)"


@plan(
    "t10_job_summaries",
    f"""SELECT id, model_type, status, created_at, {ACCURACY_SQL} AS accuracy, TRY_CAST(nullif(metrics ->> '$.loss', '') AS DOUBLE) AS loss
        FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50""",
    "jobs",
)
def _(t: Tables):
    return T.job_summaries(t["jobs"], 50)


@plan(
    "t11_job_kpis",
    f"""SELECT count(*) FILTER (promoted) AS promoted, count(*) FILTER (status = 'running') AS running,
        round(avg({ACCURACY_SQL}), 8) AS mean_accuracy FROM jobs""",
    "jobs",
)
def _(t: Tables):
    return T.job_kpis(t["jobs"]).withColumn("mean_accuracy", rounded("mean_accuracy", 8))
