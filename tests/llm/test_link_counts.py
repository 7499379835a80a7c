"""Link counts of the similarity join against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from vitalweave.llm import link_counts, ngram_join

WORDS = [f"w{i}" for i in range(50)]
DOCS = "doc_id long, text string, node string, family int"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.mark.parametrize("few, tile, entries, exact", [(16, 2048, 4 << 20, 1 << 24), (2, 5, 4 << 20, 1 << 24), (2, 6, 150, 20)])
def test_link_counts_match_brute_force(spark, monkeypatch, few, tile, entries, exact):
    monkeypatch.setattr(ngram_join, "FEW_ROWS", few)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    monkeypatch.setattr(link_counts, "TILE_ENTRIES", entries)
    monkeypatch.setattr(link_counts, "EXACT", exact)
    draw = random.Random(tile)
    texts = [None, "", " ", "A b", "a B"]
    for size, number in ((3, 4), (30, 25), (60, 40), (90, 6)):
        base = [draw.choice(WORDS) for _ in range(size)]
        for _ in range(number):
            own = list(base)
            for _ in range(draw.choice((0, 1, 1, 2))):
                own[draw.randrange(len(own))] = draw.choice(WORDS)
            texts.append(" ".join(own[: draw.choice((size, size, size - size // 6))]))
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "n", 1), (40, texts[40], "n", 1)]
    sets = [shingles(r[1]) for r in rows]
    wanted = sorted(str((r[0], len(own), sum(linked(own, other) for j, other in enumerate(sets) if i != j))) for i, (r, own) in enumerate(zip(rows, sets)))
    docs = spark.createDataFrame(rows, DOCS)
    found = link_counts.jaccard_degrees(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.n_links)) for r in found) == wanted
    groups = {str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.jaccard_components(docs).collect()}
    assert {str((r.doc_id, r.n_shingles, r.component_id)) for r in found} == groups


def test_link_counts_of_an_empty_table(spark):
    found = link_counts.jaccard_degrees(spark.createDataFrame([], DOCS))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and found.count() == 0
