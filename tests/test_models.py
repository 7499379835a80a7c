from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalweave.operators import features as X
from vitalweave.operators import model as T
from vitalweave.sources.tables import load_latest_model, save_model

START = datetime(2024, 1, 1)


def plain_fit(x, y, epochs, rate):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - rate * (x.T @ error) / len(y)
        b = b - rate * error.mean()
    return b, w


@pytest.fixture(scope="module")
def samples(spark):
    random = np.random.default_rng(5)
    x = np.round(random.normal(size=(400, 2)), 2)
    y = (x[:, 0] - x[:, 1] > 0.2).astype(float)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    return spark.createDataFrame(rows * 2, "a double, b double, label double"), x, y


def test_full_training_equals_plain_descent(samples):
    df, x, y = samples
    model = T.fit_logistic(df, ["a", "b"], epochs=200, rate=0.05)
    bias, weights = plain_fit(x, y, 200, 0.05)
    assert model.bias == pytest.approx(bias, rel=1e-6)
    assert list(model.coefficients) == pytest.approx(list(weights), rel=1e-6)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    figures = T.evaluate_logistic(df, model).first()
    assert figures["samples"] == 800
    assert figures["loss"] == pytest.approx(float(np.mean(-y * np.log(p + 1e-9) - (1 - y) * np.log(1 - p + 1e-9))), rel=1e-6)
    assert figures["accuracy"] == pytest.approx(float(((p >= 0.5) == (y == 1)).mean()))


def test_no_numeric_rows(spark):
    rows = T.build_dataset(spark.createDataFrame([("118/76",), (None,)], "value string"))
    with pytest.raises(T.NoTrainingData):
        T.fit_logistic(rows)


def test_dataset_labels(spark):
    rows = spark.createDataFrame([("119.9",), (" 120 ",), ("5d",)], "value string")
    assert [tuple(r) for r in T.build_dataset(rows).collect()] == [(119.9, 0.0), (120.0, 1.0)]


def test_request_features_win(spark):
    stored = spark.createDataFrame([("e1", {"value": "100", "age": "40"})], "entity_id string, features map<string,string>")
    requests = spark.createDataFrame(
        [(1, "e1", "", {"value": "7.5"}), (2, "e1", "m", {"value": "high"}), (3, "e2", "m", None), (4, "e1", "m", {"value": None})],
        "request_id int, entity_id string, model_name string, features map<string,string>",
    )
    merged = T.merge_features(stored, requests)
    got = {r["request_id"]: r["numeric"] for r in merged.collect()}
    assert got == {1: {"value": 7.5, "age": 40.0}, 2: {"age": 40.0}, 3: {}, 4: {"age": 40.0}}
    model = T.LogisticModel(("value",), -1.0, (0.1,))
    scored = {r["request_id"]: r for r in T.score(merged, model).collect()}
    assert scored[1]["risk_score"] == pytest.approx(1 / (1 + np.exp(0.25)))
    assert scored[2]["risk_score"] is None and scored[2]["error"] == "missing feature value"
    answered = T.score_or_default(merged, model)
    rows = {r["request_id"]: r for r in answered.collect()}
    assert (rows[3]["risk_score"], rows[3]["category"], rows[3]["confidence"]) == (0.75, "high_risk", 0.85)
    assert rows[1]["category"] is None and rows[1]["confidence"] == rows[1]["risk_score"]
    log = T.prediction_log(answered, F.lit(1.5), F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert {r["id"]: r["model_name"] for r in log} == {1: "risk-score", 2: "m", 3: "m", 4: "m"}


def test_model_without_features_cannot_score(spark):
    rows = spark.createDataFrame([({"a": 1.0},)], "numeric map<string,double>")
    assert T.score(rows, T.LogisticModel((), 0.0, ())).first()["error"] == "artifact missing feature names"


def test_model_registry(spark, tmp_path):
    path = str(tmp_path / "models")
    for job, at, bias in (("j1", "2024-01-01", 1.0), ("j2", "2024-01-03", 2.0), ("j3", "2024-01-02", 3.0)):
        save_model(T.model_rows(spark.range(1), T.LogisticModel(("value",), bias, (0.5,)), "risk", job, at), path)
    assert T.to_model(load_latest_model(spark, path, "risk").first()) == T.LogisticModel(("value",), 2.0, (0.5,))
    assert load_latest_model(spark, path, "none").count() == 0


def stored(spark, rows):
    full = [(e, v, {"v": str(v)}, START + timedelta(minutes=m), s) for e, v, m, s in rows]
    schema = "entity_id string, version long, features map<string,string>, created_at timestamp_ntz, source_id long"
    return spark.createDataFrame(full, schema)


def test_first_write_of_a_version_wins(spark):
    rows = stored(spark, [("a", 1, 5, 1), ("a", 1, 3, 2), ("a", 2, 1, 3), ("b", 1, 1, 4)])
    existing = stored(spark, [("a", 2, 0, 9)])
    got = {(r["entity_id"], r["version"]): r["source_id"] for r in X.append_features(rows, existing).collect()}
    assert got == {("a", 1): 2, ("b", 1): 4}


def test_online_rows_expire(spark):
    rows = stored(spark, [("a", 1, 0, 1), ("a", 2, 8, 2), ("b", 1, 4, 3), ("c", 1, 20, 4)])
    as_of = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    online = X.online_features(rows, as_of)
    assert {r["entity_id"]: r["version"] for r in online.collect()} == {"a": 2}
    resolved = X.resolve_features(online, X.latest_features(rows))
    assert {r["entity_id"]: r["feature_source"] for r in resolved.collect()} == {"a": "online", "b": "offline", "c": "offline"}
