from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitalweave.functions.groups import running_total, top_n_per_key
from vitalweave.operators import cohort as C
from vitalweave.operators.cohort import BadClause, Clause, CohortQuery
from vitalweave.sources.tables import append_facts, export_cohort, read_facts

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (i, f"p{0 if i % 3 else i}", f"m{i % 5}", f"t{i % 2}", "Observation" if i % 4 else "Condition",
         "blood-glucose" if i % 2 else "heart-rate", [str(90 + i), "118/76", None][i % 3 if i % 9 else 0], "u",
         START + timedelta(hours=i))
        for i in range(300)
    ]
    schema = (
        "id long, patient_id string, master_id string, tenant_id string, resource_type string, concept string, "
        "value string, unit string, timestamp timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_all_operators_on_loose_values(facts):
    known = [(r["id"], r["value"]) for r in facts.collect()]
    numbers = {i: float(v) for i, v in known if v and v.replace(".", "").isdigit()}
    checks = {"=": lambda v: v == 120, "!=": lambda v: v != 120, ">": lambda v: v > 120, "<": lambda v: v < 120,
              ">=": lambda v: v >= 120, "<=": lambda v: v <= 120, "in": lambda v: v in (120, 126)}
    for op, check in checks.items():
        literal = "(120, '126')" if op == "in" else "'120'"
        got = ids(C.cohort_filter(facts, [Clause("value", op, literal)]))
        assert got == sorted(i for i, v in numbers.items() if check(v)), op


def test_bad_clauses(facts):
    bad = [Clause("ward", "=", "3"), Clause("value", ">", "high"), Clause("timestamp", ">", "yesterday"),
           Clause("concept", "~", "x"), Clause("unit", "=", "''")]
    for clause in bad:
        with pytest.raises(BadClause):
            C.cohort_filter(facts, [clause])
    good = Clause("concept", "=", "HEART-RATE")
    assert C.dropped_clauses(facts, [*bad, good]) == bad
    lenient = C.cohort_filter(facts, [*bad, good], strict=False)
    assert ids(lenient) == ids(facts.filter("concept = 'heart-rate'"))


def test_filters_reach_the_file_scan(spark, facts, tmp_path, capsys):
    path = str(tmp_path / "facts")
    append_facts(facts, path)
    append_facts(facts.withColumn("id", F.col("id") + 1000), path)
    stored = read_facts(spark, path)
    assert stored.count() == 600
    rows = C.cohort_filter(stored, [Clause("resource_type", "=", "observation"), Clause("patient_id", "=", "p0")], tenant="t1")
    C.cohort_count(rows).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(resource_type" in plan
    assert "EqualTo(patient_id,p0)" in plan and "EqualTo(tenant_id,t1)" in plan
    assert "canonical" not in plan and "ReadSchema: struct<patient_id:string,tenant_id:string>" in plan


def test_many_cohorts_equal_single_cohorts(spark, facts):
    table = spark.createDataFrame(
        [("a", "concept", "=", "blood-glucose"), ("a", "value", ">", "150"), ("b", "master_id", "in", "m1,m2")],
        "cohort_id string, field string, op string, value string",
    )
    cohorts = C.clauses_of(table)
    got = {(r["cohort_id"], r["patient_id"]) for r in C.evaluate_cohorts(facts, cohorts).collect()}
    want = {
        (name, r["patient_id"])
        for name, clauses in cohorts.items()
        for r in C.cohort_filter(facts, clauses).select("patient_id").distinct().collect()
    }
    assert got == want
    with pytest.raises(ValueError):
        C.clauses_of(table, limit=2)


def test_timeline_of_a_hot_patient(facts):
    rows = C.timeline(facts, n=7).collect()
    want = {}
    for r in sorted(facts.collect(), key=lambda r: (r["timestamp"], r["id"])):
        want.setdefault(r["patient_id"], []).append(r["id"])
    got = {}
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["id"])):
        got.setdefault(r["patient_id"], []).append(r["id"])
    assert got == {p: v[:7] for p, v in want.items()}


def test_top_n_needs_a_positive_size(facts):
    with pytest.raises(ValueError):
        top_n_per_key(facts, ["patient_id"], [F.asc("id")], 0)


def test_running_total_over_buckets(facts):
    rows = running_total(
        facts, ["patient_id"], [F.asc("id")], F.col("id"), F.floor(F.col("id") / 40), "total"
    ).collect()
    sums = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        sums[r["patient_id"]] = sums.get(r["patient_id"], 0) + r["id"]
        assert r["total"] == sums[r["patient_id"]]
    assert len(rows) == 300


def test_materialized_features(facts):
    got = {r["patient_id"]: r for r in C.materialize_cohort(facts, CohortQuery(), "all").collect()}
    mine = [r for r in facts.collect() if r["patient_id"] == "p0"]
    numbers = [float(r["value"]) for r in mine if r["value"] and "/" not in r["value"]]
    last = max(mine, key=lambda r: r["timestamp"])
    row = got["p0"]
    assert row["record_count"] == len(mine)
    assert row["latest_concept"] == last["concept"] and row["latest_value"] == last["value"]
    assert row["average_value"] == pytest.approx(sum(numbers) / len(numbers))


def test_export_writes_text(spark, facts, tmp_path):
    path = str(tmp_path / "export")
    export_cohort(C.cohort_filter(facts, [Clause("patient_id", "=", "p3")]), ["patient_id", "value", "ward", "timestamp"], path)
    rows = spark.read.option("header", True).csv(path)
    assert rows.columns == ["patient_id", "value", "ward", "timestamp"]
    assert rows.first()["timestamp"] == "2024-01-01T03:00:00Z"


def test_page(facts):
    assert ids(C.page(facts, [F.asc("id")], 10, 2)) == list(range(10, 20))
