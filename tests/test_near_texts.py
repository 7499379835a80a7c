"""Classes of texts with almost the same bytes settle most texts, and the others stay open."""

import random

import pytest
from test_linkage import brute

from vitalweave.operators import linkage as L
from vitalweave.operators import near_texts as N

TEXTS = "_block int, _text string"


@pytest.fixture(scope="module")
def near():
    draw = random.Random(8)
    words = ["abcab", "pat-01234-ab", "zoë ü", "aaaaaaa", "pat-0011223344-furniture", "b"]
    registry, incoming = [], []
    for i in range(300):
        text = draw.choice(words)
        for _ in range(draw.randint(0, 2)):
            text = "".join(draw.sample(text, len(text))) if draw.random() < 0.3 else text
        cut = draw.randrange(len(text))
        text = draw.choice([text, text[:cut] + text[cut + 1 :], text[:cut] + draw.choice("abö01") + text[cut:], text[:cut] + draw.choice("abö01") + text[cut + 1 :]])
        (registry if i % 2 else incoming).append((i, i % 3 and 1, text))
    registry += [(900, 1, "abcab"), (-5, 0, "pat-01243-ab"), (901, 0, ""), (902, 1, "aa" * 30), (903, 1, "A" * 3)]
    incoming += [(1000, 0, ""), (1001, 1, " "), (1002, 1, "PAT-01234-AB"), (1003, 0, "pat-01234-ab"), (1004, 7, "b")]
    return incoming, registry


@pytest.mark.parametrize(("tile", "threshold"), [(4, 0.85), (1024, 0.85), (8, 0.95), (8, 0.6)])
def test_best_of_all_texts_is_found(spark, near, tile, threshold):
    incoming, registry = near
    frames = spark.createDataFrame(incoming, "inc_id int, block int, patient_id string"), spark.createDataFrame(registry, "reg_id int, block int, patient_id string")
    want = brute(incoming, registry, threshold)
    got = {r.inc_id: (r.reg_id, r.score) if r.method != "new" else None for r in L.link_probabilistic(*frames, "block", threshold, tile=tile).collect()}
    assert got == want and 20 < sum(x is not None for x in want.values())


def test_a_slip_is_settled_by_its_class(spark):
    known = spark.createDataFrame([(0, f"pat-{(k * 7919) % 1000003:07d}-ab", k) for k in range(3000)], TEXTS + ", _ref int")
    names = [r["_text"] for r in known.limit(200).collect()]
    swapped = {n[:8] + n[9] + n[8] + n[10:] for n in names} - {r["_text"] for r in known.collect()}
    asked = spark.createDataFrame([(0, n) for n in [*swapped, "pat-ab", "WALK IN, NEW"]], TEXTS)
    found, left = N.near_matches(asked, known, 0.85, 1024)
    # Only the two texts without a close partner are left to score with others, and one of them has too few bytes in common with any.
    assert {r["_text"] for r in left.collect()} == {"pat-ab", "WALK IN, NEW"}
    assert {r["_text"] for r in L.reachable(left, known).collect()} <= {"pat-ab"}
    assert {r["_text"] for r in found.collect()} == swapped


def test_large_classes_are_dealt_in_tiles(spark):
    draw = random.Random(2)
    texts = sorted({"".join(draw.sample("abcdefghij", 10)) for _ in range(400)})
    registry = [(i, 1, t) for i, t in enumerate(texts[::2])]
    incoming = [(i, 1, t) for i, t in enumerate(texts[1::2])]
    frames = spark.createDataFrame(incoming, "inc_id int, block int, patient_id string"), spark.createDataFrame(registry, "reg_id int, block int, patient_id string")
    want = brute(incoming, registry, 0.7)
    got = {r.inc_id: (r.reg_id, r.score) if r.method != "new" else None for r in L.link_probabilistic(*frames, "block", 0.7, tile=16).collect()}
    assert got == want and sum(x is not None for x in want.values()) > 100
