"""Exact ranks, pages, budget admission and byte offsets against plain computations."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalweave.functions import ranges as R
from vitalweave.operators import cleanroom as D
from vitalweave.operators import privacy as P
from vitalweave.operators.cohort import page

SHARES = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("bins, few", [(R.BINS, R.FEW), (4, 1), (3, 5)])
def test_quantiles_are_exact(spark, bins, few):
    draw = random.Random(9)
    values = [draw.choice([draw.gauss(0, 1), draw.lognormvariate(0, 9), 7.0, -1e300, 1e-300, 1e300]) for _ in range(90)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    known = [v for v in values if v is not None and v == v]
    row = spark.createDataFrame([(v,) for v in known], "x double").agg(*[F.percentile("x", s) for s in SHARES]).first()
    assert R.exact_quantiles(df, "x", SHARES, bins, few) == list(row)
    assert R.exact_ranks(df, "x", range(0, 90, 10), bins, few) == {i: v for i, v in enumerate(sorted(known)) if i % 10 == 0}


def test_quantiles_of_odd_tables(spark):
    empty = spark.createDataFrame([], "x double")
    assert R.exact_quantiles(empty, "x", [0.5]) == [None]
    same = spark.createDataFrame([(4.0,)] * 9, "x double")
    assert R.exact_quantiles(same, "x", [0.1, 0.9]) == [4.0, 4.0]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,)], "x double")
    assert R.exact_ranks(ends, "x", [0, 1, 2, 4], 4, 1) == {0: float("-inf"), 1: 1.0, 2: 2.0, 4: float("inf")}


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    return spark.createDataFrame([(i, draw.randrange(20), "x" * (i % 3)) for i in range(997)], "id long, k int, t string").repartition(6)


def test_pages_are_those_of_offsets(spark, rows, tmp_path):
    order = [F.desc("k"), F.asc("id")]
    table = R.PagedTable.build(rows, str(tmp_path / "pages"), ["k", "id"], [True, False], 120)
    assert len(table.counts) > 5 and sum(n for _, n in table.counts) == 997
    for size, number in ((10, 1), (10, 37), (300, 2), (300, 4), (997, 1), (10, 500), (0, 0)):
        assert table.page(size, number).collect() == page(rows, order, size, number).collect()
    scan = table.page(5, 190)._jdf.queryExecution().executedPlan().toString()
    assert "part" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_by_seek(rows):
    order, seen, last = [F.desc("k"), F.asc("id")], [], None
    while True:
        found = R.page_after(rows, ["k", "id"], 100, last, [True, False]).collect()
        seen += found
        if len(found) < 100:
            break
        last = [found[-1]["k"], found[-1]["id"]]
    assert seen == rows.orderBy(*order).collect()


LOG = "query_id long, owner string, epsilon double, asked_at timestamp_ntz"


def log_of(spark, values):
    df = spark.createDataFrame(values, "query_id long, owner string, epsilon double, asked int")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("asked"))
    return df.select("query_id", "owner", "epsilon", at.alias("asked_at"))


def folded(values, limit):
    left, out = {}, {}
    for query, owner, epsilon, _ in sorted(values, key=lambda v: (v[1], v[3], v[0])):
        units, spent = round(epsilon * 10**6), left.get(owner, 0)
        out[query] = spent + units <= round(limit * 10**6)
        left[owner] = spent + units * out[query]
    return out


def test_refused_queries_are_not_charged(spark):
    found = {r.query_id: (r.accepted, r.used) for r in D.admit_queries(log_of(spark, [(1, "a", 1.0, 1), (2, "a", 10.0, 2), (3, "a", 1.0, 3), (4, "b", 5.0, 1)]), 5.0).collect()}
    assert found == {1: (True, 1.0), 2: (False, 1.0), 3: (True, 2.0), 4: (True, 5.0)}


def test_an_owner_over_many_ranges_carries_its_budget(spark):
    draw = random.Random(5)
    values = [(i, "hot" if i % 3 else f"o{i % 7}", draw.choice([0.1, 0.3, 2.0, 9.0]), draw.randrange(1000)) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for limit in (0.05, 5.0, 40.0, 10_000.0):
            found = D.admit_queries(log_of(spark, values), limit)
            assert {r.query_id: r.accepted for r in found.collect()} == folded(values, limit)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert D.admit_queries(log_of(spark, []), 1.0).count() == 0


def test_answers_ask_the_budget(spark):
    df = spark.createDataFrame([(i, f"p{i}", "a", 1.0) for i in range(50)], "id long, person string, g string, v double")
    keys = spark.createDataFrame([("a",)], "g string")
    log = log_of(spark, [(1, "x", 1.5, 1), (2, "y", 9.0, 1)])
    ask = lambda epsilon, query: D.answer_query(df, ["g"], "person", "v", D.Bounds(0.0, 2.0), "id", keys, epsilon, log, 2.0, query, seed=1)
    assert ask(0.5, (7, "x", "2024-02-01 00:00:00")).count() == 1
    assert ask(2.0, (7, "y", "2024-02-01 00:00:00")).count() == 1
    with pytest.raises(D.BudgetSpent):
        ask(0.6, (7, "x", "2024-02-01 00:00:00"))


def test_offsets_are_those_of_the_expressions(spark):
    texts = ["", "ü 900-12-0001 é 900-12-0002", "call (555) 010-1234 or 555-010-1234, u1@example.com", "MRN:\v A123456 MRN:\n\tA123456", "é900-12-0001", "x_900-12-0001", None, "1/2/1970 11/12/1970"]
    df = spark.createDataFrame([(i, t, {"k": t} if t else None, i) for i, t in enumerate(texts)], "id int, a string, m map<string,string>, path int")
    want = sorted(map(tuple, P.phi_positions(df, "id", ["a", "m"]).collect()))
    assert sorted(map(tuple, P.phi_offsets(df, "id", ["a", "m"]).collect())) == want and len(want) > 10
    content = texts[1].encode()
    for r in P.phi_offsets(df, "id", ["a"]).filter("id = 1").collect():
        assert content[r.start : r.end].decode() == r.value
    assert P.phi_offsets(df.limit(0), "id", ["a"]).count() == 0


def test_offsets_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "ü 900-12-0001 " * n)], "id int, a string")
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert P.phi_offsets(df, "id", ["a"]).count() == n
            best.append(time.perf_counter() - began)
        return min(best)

    seconds(10)
    assert seconds(80_000) < 20 * max(seconds(10_000), 0.05)
    assert np.isfinite(1.0)
