"""The match index finds what scoring all pairs finds, and scores fewer."""

import random

import pytest
from pyspark.sql import functions as F
from test_scalars import plain_jaro_winkler

from vitalweave.operators import match_index as M
from vitalweave.session import shared_dir


def brute(asked, known, threshold=0.85):
    best = {}
    for block, text in asked:
        for other_block, other, ref in known:
            if block == other_block and text and other:
                score = round(plain_jaro_winkler(other.encode(), text.encode()), 10)
                if score >= threshold and ((block, text) not in best or (-score, ref) < (-best[block, text][1], best[block, text][0])):
                    best[block, text] = (ref, score)
    return best


@pytest.fixture(scope="module")
def people():
    draw = random.Random(4)
    shapes = [lambda: f"pat-{draw.randrange(10**6):06d}-{draw.choice(['ab', 'cd'])}", lambda: f"{draw.choice(['ann', 'bob', 'zoë'])} {draw.choice('xyz') * draw.randint(1, 9)}", lambda: "".join(draw.choice("abcdef") for _ in range(draw.randint(1, 14)))]
    known = [(f"b{i % 3}", draw.choice(shapes)(), f"m{i:04d}") for i in range(500)]
    known += [("b0", known[3][1], "m0000"), (None, "pat-1", "m1"), ("b1", None, "m2"), ("b1", "", "m3"), ("b2", "a" * 300, "m4")]
    asked = set()
    for _ in range(150):
        block, text, _ = draw.choice(known[:500])
        cut = draw.randrange(0, max(len(text) - 1, 1))
        asked.add((block, draw.choice([text, text[:cut] + text[cut + 1 : cut + 2] + text[cut : cut + 1] + text[cut + 2 :], text + "q", text[1:], "zz" + text])))
    return sorted((b, t) for b, t in asked if t == t.strip()), known


def test_index_finds_the_best_pair(spark, people, tmp_path):
    asked, known = people
    registry = spark.createDataFrame(known, "site string, name string, master string")
    index = M.MatchIndex.build(registry, str(tmp_path / "index"), "site", "name", "master")
    texts = spark.createDataFrame([*asked, *asked, (None, "pat-1"), ("b1", None), ("b1", "  "), ("b9", "pat-000001-ab")], "block string, text string")
    found = {(r.block, r.text): (r.ref, r.score) for r in index.match(texts).collect()}
    assert found == brute(asked, known)
    # Rounds look at few pairs where a score near one is asked for.
    rows = M.MatchIndex(spark, str(tmp_path / "index")).asked(texts)
    pairs = {s: index.candidates(rows, s).count() for s in (0.97, 0.85)}
    every = sum(1 for b, t in asked for o, k, _ in known if b == o and k)
    assert pairs[0.97] < every / 4 and pairs[0.97] < pairs[0.85] <= every


def test_rows_of_later_batches_are_hidden(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "block string, text string, ref string"
    index = M.MatchIndex.build(spark.createDataFrame([("b", "martha", "m1")], schema), path, "block", "text", "ref")
    for _ in range(2):
        index.add(spark.createDataFrame([("b", "dwayne", "m2")], schema), 3)
    asked = spark.createDataFrame([("b", "duane"), ("b", "marhta")], "block string, text string")
    assert {r.text: r.ref for r in M.MatchIndex(spark, path, before=3).match(asked, 0.85).collect()} == {"marhta": "m1"}
    assert {r.text: r.ref for r in M.MatchIndex(spark, path, before=4).match(asked, 0.85).collect()} == {"marhta": "m1"} | ({"duane": "m2"} if plain_jaro_winkler(b"dwayne", b"duane") >= 0.85 else {})
    assert M.MatchIndex(spark, path).known().count() == 2


def test_block_is_required_and_empty_tables_work(spark, tmp_path):
    schema = "block string, text string, ref string"
    empty = spark.createDataFrame([], schema)
    with pytest.raises(ValueError):
        M.MatchIndex.build(empty, str(tmp_path / "x"), "", "text", "ref")
    index = M.MatchIndex.build(empty, str(tmp_path / "index"), "block", "text", "ref")
    assert index.match(spark.createDataFrame([("b", "x")], "block string, text string")).count() == 0
    rows = spark.createDataFrame([(1, "b", " x ")], "id int, block string, patient_id string")
    assert [(r.reg_id, r.score, r.method) for r in M.link_indexed(rows, index, "block").collect()] == [(None, 1.0, "new")]
    assert shared_dir(spark)
    assert rows.select(F.col("id")).count() == 1


def test_texts_with_a_slip_need_no_candidates(spark, tmp_path, monkeypatch):
    known = [("b", f"pat-{(k * 7919) % 1000003:07d}-ab", f"m{k:04d}") for k in range(2000)]
    index = M.MatchIndex.build(spark.createDataFrame(known, "block string, text string, ref string"), str(tmp_path / "index"), "block", "text", "ref")
    seen = []
    searched = M.MatchIndex.candidates

    def candidates(self, asked, score):
        found = searched(self, asked, score)
        seen.append(found.count())
        return found

    monkeypatch.setattr(M.MatchIndex, "candidates", candidates)
    asked = {("b", t[:8] + t[9] + t[8] + t[10:]) for _, t, _ in known[:60]} | {("b", "PAT-0000001-AB"), ("b", known[7][1])}
    found = {(r.block, r.text): (r.ref, r.score) for r in index.match(spark.createDataFrame(sorted(asked), "block string, text string")).collect()}
    assert found == brute(asked, known)
    # Those that the classes of equal bytes settle are not looked up by their rare bytes.
    assert sum(seen) < 5
