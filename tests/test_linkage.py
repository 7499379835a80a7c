import random
import re

import pytest
from pyspark.sql import functions as F
from test_scalars import plain_jaro_winkler

from vitalweave.operators import linkage as L
from vitalweave.sources.fixtures import load

SF_DIR = "/root/testdata/sf0.001"


def brute(incoming, registry, threshold=0.85):
    best = {}
    for inc, block, text in incoming:
        found = None
        for ref, other, known in registry:
            if other != block:
                continue
            score = round(plain_jaro_winkler(known.encode(), text.strip().encode()), 10)
            if score >= threshold and (found is None or (-score, ref) < (-found[1], found[0])):
                found = (ref, score)
        best[inc] = found
    return best


@pytest.fixture(scope="module")
def people():
    random.seed(3)
    registry = [(i, 0 if i % 3 else i % 5, f"pat-{random.randrange(10**5):05d}-{random.choice(['ab', 'cd'])}") for i in range(400)]
    registry += [(1000 + i, 0, registry[1][2]) for i in range(50)]
    incoming = []
    for i in range(120):
        _, block, text = random.choice(registry)
        cut = random.randrange(4, 10)
        text = text if i % 4 == 0 else text[:cut] + text[cut + 1 : cut + 2] + text[cut : cut + 1] + text[cut + 2 :]
        incoming.append((i, block, f" {text} " if i % 5 else "zz"))
    return incoming, registry


def frames(spark, people, seed=0):
    incoming, registry = [list(rows) for rows in people]
    random.seed(seed)
    random.shuffle(incoming)
    random.shuffle(registry)
    return (
        spark.createDataFrame(incoming, "inc_id int, block int, patient_id string"),
        spark.createDataFrame(registry, "reg_id int, block int, patient_id string"),
    )


@pytest.mark.parametrize("tile", [8, 2048])
def test_best_match_equals_brute_force(spark, people, tile):
    rows = L.link_probabilistic(*frames(spark, people), "block", tile=tile).collect()
    want = brute(*people)
    assert len(rows) == len(people[0])
    for r in rows:
        found = want[r["inc_id"]]
        assert (r["reg_id"], r["score"], r["method"]) == (
            (found[0], pytest.approx(found[1]), "probabilistic") if found else (None, 1.0, "new")
        )


def test_input_order_does_not_matter(spark, people):
    first = L.link_probabilistic(*frames(spark, people, 1), "block", tile=16)
    second = L.link_probabilistic(*frames(spark, people, 2), "block", tile=64)
    assert sorted(first.collect()) == sorted(second.collect(), key=tuple) or {tuple(r) for r in first.collect()} == {
        tuple(r) for r in second.collect()
    }


def test_no_cross_join_in_the_plan(spark, people, capsys):
    L.link_probabilistic(*frames(spark, people), "block").explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert re.search(r"hashpartitioning\(_block#\d+L?, _left_tile", plan), "a hot block is grouped by tile, not by block"
    assert re.search(r"hashpartitioning\(_block#\d+L?, _right_tile", plan)


def test_key_takes_the_first_field_with_a_value(spark):
    rows = spark.createDataFrame([(" A ", "m"), (" ", "M2 "), (None, None)], "patient_id string, mrn string")
    got = [r["link_key"] for r in L.deterministic_key(rows, [" Patient_ID", "mrn", "none"]).collect()]
    assert got == ["patient_id:a", "mrn:m2", None]


def test_newest_master_is_reused(spark):
    links = spark.sql(
        "SELECT * FROM VALUES (1, 'm1', 'patient_id:a', TIMESTAMP_NTZ'2024-01-01'), (2, 'm2', 'patient_id:a', TIMESTAMP_NTZ'2024-01-02'), "
        "(3, 'm3', '', TIMESTAMP_NTZ'2024-01-03') t(id, master_id, deterministic_key, created_at)"
    )
    rows = spark.createDataFrame([("a",), ("b",), ("",)], "patient_id string")
    got = {r["patient_id"]: r for r in L.link_deterministic(L.deterministic_key(rows, ["patient_id"]), links).collect()}
    assert got["a"]["master_id"] == "m2" and not got["a"]["is_new"]
    assert got["b"]["is_new"] and got["b"]["master_id"].startswith("master-")
    assert got[""]["master_id"] is None and got[""]["is_new"] is False


def test_summary_is_bounded(spark):
    links = load(spark, SF_DIR, "links").withColumn("patient_id", F.lit("one"))
    row = L.linkage_summary(links).first()
    assert len(row["linked_patients"]) == 25
    newest = links.orderBy(F.desc("created_at"), F.desc("id")).first()
    assert row["master_id"] == newest["master_id"] and row["linked_patients"][0]["id"] == newest["id"]
