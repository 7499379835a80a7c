from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalweave.functions import scalars as S
from vitalweave.functions.similarity import TextBatch, best_matches, jaro_winkler, scores
from vitalweave.sources.tables import export_rows


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [("110", 110.0), (" 7.5 ", 7.5), ("118/76", None), ("", None), (None, None), ("5d", None), ("inf", None), ("-1e3", -1000.0), (".5", 0.5)],
)
def test_numeric_text(spark, text, expected):
    assert one(spark, text, S.text_number) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.25+02:00", datetime(2024, 1, 2, 1, 4, 5, 250000)),
        ("2024-01-02 03:04", datetime(2024, 1, 2, 3, 4)),
        ("2024-01-02", datetime(2024, 1, 2)),
        ("yesterday", None),
        ("2024-13-02", None),
    ],
)
def test_time_text(spark, text, expected):
    assert one(spark, text, S.parse_time) == expected


def test_time_text_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, "2024-07-02T03:04:05Z", S.parse_time) == datetime(2024, 7, 2, 3, 4, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_export_text(spark):
    rows = spark.sql(
        "SELECT CAST(NULL AS STRING) AS a, 1.5D AS b, TIMESTAMP '2024-01-02 03:04:05' AS c, true AS d, array(1, 2) AS e, 7 AS f"
    )
    row = export_rows(rows, ["a", "b", "c", "d", "e", "f", "g"]).first()
    assert tuple(row) == ("", "1.500000", "2024-01-02T03:04:05Z", "true", "[1,2]", "7", "")


def test_slug_and_quotes(spark):
    assert one(spark, " High Risk/É ", S.slug) == "high-risk--"
    assert one(spark, "   ", S.slug) == "cohort-export"
    assert one(spark, " '\"x\"' ", S.strip_quotes) == "x"
    assert one(spark, " a\t", S.clean) == "a"


def test_tokens_are_stable_per_salt(spark):
    first, second = one(spark, "x", lambda c: S.token(c, "s")), one(spark, "x", lambda c: S.token(c, "s"))
    assert first == second and first.startswith("token_") and len(first) == 22
    assert one(spark, "x", lambda c: S.token(c, "other")) != first
    assert one(spark, "x", lambda c: S.random_token(c, "s")) != one(spark, "x", lambda c: S.random_token(c, "s"))


def plain_jaro_winkler(a: bytes, b: bytes) -> float:
    """Textbook form over single characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = set(), []
    for i, char in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == char:
                taken.add(j)
                left.append(char)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


TEXT = st.text(alphabet="abc01-", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=20))
def test_batch_similarity_equals_textbook(pairs):
    got = scores(TextBatch([a for a, _ in pairs]), TextBatch([b for _, b in pairs]))
    assert got.tolist() == pytest.approx([plain_jaro_winkler(a.encode(), b.encode()) for a, b in pairs])


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.lists(TEXT, min_size=1, max_size=60), st.sampled_from([0.3, 0.5, 0.85]))
def test_best_match_misses_nothing(texts, many, floor):
    for text, found in zip(texts, best_matches(texts, TextBatch(many), floor, probe=3)):
        all_scores = [round(plain_jaro_winkler(text.encode(), m.encode()), 10) for m in many]
        best = max(all_scores)
        assert found == ((all_scores.index(best), pytest.approx(best, abs=1e-9)) if best >= floor else None)


def test_similarity_column(spark):
    rows = spark.createDataFrame(
        [("patient-001", "patient-001"), ("x", ""), ("patient-001", "patient-010"), (None, "a")], "a string, b string"
    )
    got = [r[0] for r in rows.select(jaro_winkler("a", "b")).collect()]
    assert got[:3] == [1.0, 0.0, pytest.approx(0.98181818, abs=1e-8)]
    assert got[3] is None


def test_similarity_of_empty_frame(spark):
    assert spark.createDataFrame([], "a string, b string").select(jaro_winkler("a", "b")).collect() == []
