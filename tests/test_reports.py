from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalweave.operators import cleanroom as D
from vitalweave.operators import reports as M
from vitalweave.operators import studies as E
from vitalweave.plans.registry import Tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.mark.parametrize(
    "first, second, expected",
    [(True, True, "healthy"), (True, False, "degraded"), (False, True, "degraded"), (False, False, "failing")],
)
def test_ladder(spark, first, second, expected):
    assert spark.range(1).select(M.ladder(F.lit(first), F.lit(second)).alias("s")).first()["s"] == expected


def logs(spark, values):
    rows = [(i, "p", "m", float(v), 0.5, datetime(2024, 1, 1, 0, 0, i)) for i, v in enumerate(values)]
    schema = "id long, patient_id string, model_name string, latency_ms double, confidence double, created_at timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_quantiles_interpolate(spark):
    row = M.prediction_summary(logs(spark, [10, 1, 4, 2])).first()
    assert (row["p50_latency_ms"], row["p95_latency_ms"]) == (3.0, pytest.approx(9.1))
    assert row["total"] == 4 and row["window_seconds"] == 3


def test_summary_of_nothing(spark):
    row = M.prediction_summary(logs(spark, [])).first()
    assert tuple(row) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_undecodable_payload_is_kept(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, '{\"a\":1}'), (2, '[1]'), (3, 'x\"y'), (4, NULL) t(id, payload)"
    ).selectExpr("id", "payload", "'lab' source", "'csv' format", "'failed' status", "CAST(NULL AS STRING) error",
                 "TIMESTAMP_NTZ'2024-01-02 03:04:05' updated_at")
    got = {r["id"]: r["payload"] for r in M.alert_items(rows).collect()}
    assert got == {1: '{"a":1}', 2: '{"raw":"[1]"}', 3: '{"raw":"x\\"y"}', 4: "{}"}
    assert M.alert_items(rows).first()["updated_at"] == "2024-01-02T03:04:05Z"


def test_form_versions_continue(spark):
    submitted = spark.createDataFrame([(i, 1, "a" if i % 3 else "b", i) for i in range(50)], "form_id int, study_id int, slug string, submitted_seq int")
    existing = spark.createDataFrame([(1, "a", 4)], "study_id int, slug string, version int")
    rows = E.assign_form_versions(submitted, existing, F.floor(F.col("submitted_seq") / 7)).collect()
    got = {s: [r["version"] for r in sorted(rows, key=lambda r: r["submitted_seq"]) if r["slug"] == s] for s in "ab"}
    assert got["a"] == list(range(5, 5 + 33)) and got["b"] == list(range(1, 18))


def test_consent_enrols_the_subject(spark):
    subjects = spark.createDataFrame([(1, "screening"), (2, "withdrawn")], "subject_id int, status string")
    signatures = spark.sql(
        "SELECT * FROM VALUES (1, 1, TIMESTAMP_NTZ'2024-02-02', TIMESTAMP_NTZ'2024-03-01'), "
        "(2, 1, TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-03-02') t(signature_id, subject_id, signed_at, recorded_at)"
    )
    got = {r["subject_id"]: r for r in E.apply_consents(subjects, signatures).collect()}
    assert got[1]["status"] == "enrolled" and got[1]["consented_at"] == datetime(2024, 1, 1)
    assert got[2]["status"] == "withdrawn" and got[2]["consented_at"] is None


def test_audit(spark):
    events = spark.createDataFrame([(1, 7, "", "x"), (2, None, "a", "x"), (3, 7, "a", "y")], "id int, study_id int, actor string, action string")
    assert [(r["id"], r["actor"]) for r in E.audit_rows(events).orderBy("id").collect()] == [(1, "system"), (3, "a")]


def test_defaults(spark):
    visits = spark.createDataFrame([(None,), (False,)], "required boolean")
    assert [r["required"] for r in E.with_defaults(visits, "visit_templates").collect()] == [True, False]
    assert E.with_defaults(spark.range(1), "studies").first()["status"] == "draft"


def test_integrity(spark):
    child = spark.createDataFrame([(1, 1), (2, 5), (3, None), (4, 1)], "id int, parent int")
    assert [tuple(r) for r in E.duplicate_keys(child, ["parent"]).collect()] == [(1, 2)]
    parent = spark.createDataFrame([(1,)], "key int")
    assert [r["id"] for r in E.orphans(child, parent, "parent", "key").collect()] == [2]


def test_hot_key_ranking_is_spread(tables, capsys):
    E.audit_tail(E.audit_rows(tables["audit_events"])).explain()
    plan = capsys.readouterr().out
    assert "_salt" in plan and plan.count("WindowGroupLimit") >= 4


def test_ledger_never_passes_its_limit(tables):
    rows = D.budget_ledger(tables["room_log"], 5.0).collect()
    spent = {}
    for r in rows:
        if r["accepted"]:
            spent[r["owner"]] = spent.get(r["owner"], 0) + r["epsilon"]
    assert spent and max(spent.values()) <= 5.0 + 1e-9
    assert any(not r["accepted"] for r in rows)


def test_noise_has_the_right_size_and_people_are_bounded(spark):
    rows = spark.range(4000).selectExpr("id", "concat('g', id % 400) AS g", "concat('p', id % 50) AS person", "1000.0D AS v")
    listed = rows.select("g").distinct()
    bounds = D.Bounds(0.0, 10.0, 20)
    exact = D.exact_aggregate(rows, ["g"], "person", "v", bounds, "id", listed)
    assert exact.agg(F.sum("n"), F.sum("total")).first() == (50 * 20, 50 * 20 * 10.0)
    noisy = D.dp_aggregate(rows, ["g"], "person", "v", bounds, "id", listed, epsilon=1.0, seed=11)
    both = noisy.join(exact, "g").select((F.col("noisy_n") - F.col("n")).alias("a"), (F.col("noisy_total") - F.col("total")).alias("b"))
    draws = np.array([tuple(r) for r in both.collect()])
    # A Laplace draw of scale b has mean absolute value b: 20 / 0.5 for counts, ten times that for sums.
    assert np.abs(draws[:, 0]).mean() == pytest.approx(40, rel=0.25)
    assert np.abs(draws[:, 1]).mean() == pytest.approx(400, rel=0.25)
    assert abs(np.corrcoef(draws.T)[0, 1]) < 0.2
    assert abs(draws[:, 0].mean()) < 12
    with pytest.raises(ValueError):
        D.dp_aggregate(rows, ["g"], "person", "v", bounds, "id", listed, epsilon=0.0)


def test_absent_public_keys_get_noise_too(spark):
    rows = spark.createDataFrame([(1, "a", "p", 1.0), (2, "hidden", "p", 1.0)], "id int, g string, person string, v double")
    listed = spark.createDataFrame([("a",), ("b",)], "g string")
    got = {r["g"] for r in D.dp_aggregate(rows, ["g"], "person", "v", D.Bounds(0, 1), "id", listed, 1.0).collect()}
    assert got == {"a", "b"}
