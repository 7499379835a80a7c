"""Exact deduplication against brute force: nulls, ties, repeated rows, empty tables, clashing names, a hot text."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from vitalweave.llm import exact_copies

DOCS = "doc_id long, text string, _digest string, _size string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda x: (x is not None, x))
        digest = hashlib.sha256(text.encode()).hexdigest()
        ids.remove(best)
        out += [(best, best, len(ids) + 1, True, digest), *((i, best, len(ids) + 1, False, digest) for i in ids)]
    return sorted(out, key=str)


def some_rows():
    draw = random.Random(5)
    texts = [None, "", " ", "a", "A", "é", "é", "long " * 50_000, *(f"t{i}" for i in range(40))]
    rows = [(i, draw.choice(texts), "x", "y") for i in range(300)]
    rows += [(1000 + i, "hot", "x", "y") for i in range(200)]
    return rows + [(1199, "hot", "x", "y"), (1199, "hot", "x", "y"), (None, "hot", None, None), (None, "alone", None, None), (None, "alone", None, None)]


@pytest.mark.parametrize("tracked, frequent", [(exact_copies.TRACKED, exact_copies.FREQUENT), (16, 2)])
def test_copies_are_those_of_brute_force(spark, tracked, frequent):
    rows = some_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    found = [tuple(r) for r in exact_copies.mark_copies(df, tracked=tracked, frequent=frequent).collect()]
    assert sorted(found, key=str) == brute(rows)
    left = exact_copies.drop_copies(df, tracked=tracked, frequent=frequent)
    assert left.columns == ["doc_id", "text", "_digest", "_size"]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, digest(r.text)) for r in left.collect()), key=str) == sorted(((r[0], r[4]) for r in brute(rows) if r[3]), key=str)


def test_frequent_texts_do_not_reach_the_shuffle(spark):
    rows = spark.createDataFrame(some_rows(), DOCS)
    from pyspark.sql import functions as F

    digests = rows.select(F.col("doc_id").alias("_id"), exact_copies.text_digest("text").alias("_digest"))
    winners = exact_copies.frequent_winners(digests, F.col("_id"), 16, 2).collect()
    assert 0 < len(winners) <= 2 and max(w._size for w in winners) == 203
    plan = exact_copies.mark_copies(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_copies.mark_copies(empty).count() == 0 and exact_copies.drop_copies(empty).count() == 0
