"""Ranked search against brute force: ties at the last place, nulls, repeated rows, several blocks, small tiles."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vitalweave.llm import lexical

DOCS = "doc_id long, text string, _item int, score string"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    rows = []
    for item in items:
        found = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in set(terms(item[1])) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // n_all
                score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        rows += [(item[0], rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(found, key=str_null)[:k], 1)]
    return sorted(rows, key=str)


def str_null(row):
    return row[0], row[1], row[2] or 0


def some_rows():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ähre", "ähre", "x_y", "A1", "a1", "é-è"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, text(draw.randint(0, 30)), i, "s") for i in range(200)]
    docs += [(1000 - i, "w1 w2 same", 0, "") for i in range(30)] + [(7, "w3 w3", 0, ""), (7, "w3 w3", 0, ""), (None, "w1 w2 same", 0, ""), (None, None, 0, ""), (2000, None, 0, ""), (2001, "", 0, ""), (2002, "w9 " * 3000, 0, "")]
    items = [(i, text(draw.randint(1, 12)), 0) for i in range(12)] + [(50, "w1 W2 SAME", 0), (50, "w1 W2 SAME", 0), (None, "w3", 0), (60, None, 0), (61, "-- !", 0), (62, "unknown", 0)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_is_brute_force(spark, monkeypatch, small):
    docs, items = some_rows()
    if small:
        for name, value in {"TILE_DOCS": 7, "TILE_TERMS": 5, "TILE_ITEMS": 3, "KEPT_TILES": 2, "PART_BYTES": 50}.items():
            monkeypatch.setattr(lexical, name, value)
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), 9, block_bytes=200 if small else lexical.BLOCK_BYTES)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 9)


def test_tiles_of_any_size_give_the_same_best(monkeypatch):
    docs, items = some_rows()
    for name, value in {"TILE_TERMS": 5, "TILE_ITEMS": 3, "KEPT_TILES": 2, "PART_BYTES": 50}.items():
        monkeypatch.setattr(lexical, name, value)
    block = lexical.Block([(t or "").encode() for _, t, _ in items])
    counted = [lexical.count_terms((d[1] or "").encode(), block.terms) for d in docs]
    n = np.array([c[0] for c in counted])
    n_docs, n_terms = int((n > 0).sum()), int(n.sum())
    found = Counter(t for _, own in counted for t, _ in own)
    scorer = lexical.Scorer(block.pairs, block.items, np.array([lexical.weight(n_docs, found[i]) for i in range(len(block.terms))]), n_docs, n_terms)
    best = lexical.Best(block.items, 9)
    for at in range(0, len(docs), 7):
        part = counted[at : at + 7]
        flat = np.array([x for _, own in part for x in own], np.int64).reshape(-1, 2)
        scores = scorer.scores(n[at : at + 7], np.array([len(own) for _, own in part]), flat[:, 0], flat[:, 1])
        ids = [d[0] for d in docs[at : at + 7]]
        best.add(scores, np.array([i or 0 for i in ids]), np.array([i is None for i in ids]))
    ranks = Counter()
    rows = []
    for item, score, own, null in zip(*best.rows):
        ranks[item] += 1
        rows.append((items[item][0], ranks[item], None if null else int(own), int(score)))
    assert sorted(rows, key=str) == brute(docs, items, 9)


def test_partial_sums_stay_exact():
    scorer = lexical.Scorer(np.zeros((0, 2), np.int64), 1, np.array([90_000]), 5, 5)
    assert scorer.width == lexical.TILE_TERMS and scorer.width * 90_000 * lexical.MOST_IMPACT < lexical.EXACT
    scorer = lexical.Scorer(np.zeros((0, 2), np.int64), 1, np.array([1 << 40]), 5, 5)
    assert scorer.width == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame(some_rows()[1], ITEMS)
    for left, right in ((docs, items), (docs, some), (spark.createDataFrame(some_rows()[0], DOCS), items)):
        assert lexical.search(left, right).count() == 0
