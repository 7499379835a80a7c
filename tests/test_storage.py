"""Stored batches: first write wins, compaction, partition pruning."""

import glob

import pytest
from pyspark.sql import functions as F

from vitalweave.operators.cohort import Clause, cohort_filter
from vitalweave.sources.fact_table import FactTable
from vitalweave.sources.fixtures import load
from vitalweave.streaming.feature_store import KeyedFeatures

SF_DIR = "/root/testdata/sf0.001"
ROWS = "entity_id string, version long, features map<string,string>, created_at timestamp_ntz, source_id string"


def feature(entity, version, value, source, at="2024-01-01 00:00:00"):
    return entity, version, {"v": value}, at, source


def rows_of(spark, values):
    kinds = "entity_id string, version long, features map<string,string>, created_at string, source_id string"
    return spark.createDataFrame(values, kinds).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_first_write_stays_over_batches_and_replays(spark, tmp_path):
    store = KeyedFeatures(spark, str(tmp_path / "features"), 4)
    first = rows_of(spark, [feature("a", 1, "first", "z"), feature("a", 1, "later", "zz"), feature("b", 1, "b1", "q")])
    second = rows_of(spark, [feature("a", 1, "second", "a"), feature("a", 2, "a2", "a"), feature("c", 1, "c1", "a")])
    want = {("a", 1): "first", ("b", 1): "b1", ("a", 2): "a2", ("c", 1): "c1"}
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0), (rows_of(spark, []), 2), (second, "replay-0")):
        store.append(rows, batch)
    found = store.read().collect()
    assert len(found) == 4 and {(r.entity_id, r.version): r.features["v"] for r in found} == want
    keys = store.stored_keys(first, [1, 2], "1")
    plan = keys._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


@pytest.fixture(scope="module")
def facts(spark):
    return load(spark, SF_DIR, "facts")


def files(path):
    return glob.glob(f"{path}/**/*.parquet", recursive=True)


def test_compaction_keeps_rows_and_bounds_files(spark, facts, tmp_path):
    path = str(tmp_path / "facts")
    table = FactTable(spark, path)
    for batch in range(6):
        table.append(facts.filter(F.col("id") % 6 == batch), batch)
    before = table.read()
    plain = sorted(map(str, before.select("id", "value").collect()))
    assert table.version() == (0, [])
    assert table.compact([0, 1, 2, 99]) == 1 and table.version() == (1, ["0", "1", "2"])
    assert table.compact(range(5)) == 2
    assert table.compact(range(5)) == 2
    assert sorted(map(str, table.read().select("id", "value").collect())) == plain == sorted(map(str, facts.select("id", "value").collect()))
    # Readers that began before still find their files.
    assert sorted(map(str, before.select("id", "value").collect())) == plain
    days = facts.select("resource_type", F.to_date("timestamp")).distinct().count()
    compacted = [f for f in files(path) if "_compacted/v=00000002" in f]
    assert len(compacted) <= days < len([f for f in files(path) if "batch_id" in f])
    table.append(facts.filter(F.col("id") % 6 == 5), 5)
    assert len(table.vacuum()) == 6 and sorted(map(str, table.read().select("id", "value").collect())) == plain


def test_a_version_counts_when_it_is_complete(spark, facts, tmp_path):
    path = str(tmp_path / "facts")
    table = FactTable(spark, path)
    table.append(facts.filter("id % 2 = 0"), 0)
    table.append(facts.filter("id % 2 = 1"), 1)
    table.compact([0])
    lost = tmp_path / "facts" / "_versions" / "v=00000007"
    lost.mkdir()
    assert table.version() == (1, ["0"]) and table.read().count() == facts.count()
    assert table.compact([0, 1]) == 8 and table.read().count() == facts.count()


def test_time_clauses_prune_days(spark, facts, tmp_path):
    table = FactTable(spark, str(tmp_path / "facts"))
    table.append(facts, 0)
    stored = table.read()
    low, high = [r[0] for r in facts.selectExpr("inline(array(struct(min(timestamp) AS t), struct(max(timestamp) AS t)))").collect()]
    middle = low + (high - low) / 2
    cases = [(">=", middle), (">", middle), ("<", middle), ("<=", middle), ("=", low), ("in", [low, high]), ("!=", low)]
    for op, value in cases:
        text = [v.isoformat(sep=" ", timespec="minutes") for v in value] if op == "in" else value.isoformat(sep=" ", timespec="minutes")
        clause = Clause("timestamp", op, text)
        found = cohort_filter(stored, [clause])
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in cohort_filter(facts, [clause]).collect())
        scan = found._jdf.queryExecution().executedPlan().toString()
        assert ("event_date" in scan.split("PartitionFilters: [")[1].split("]")[0]) == (op != "!=")
