import re

import pytest
from pyspark.sql import functions as F

from vitalweave.operators import privacy as P
from vitalweave.sources.reference_data import CLINICAL_RULES, DEFAULT_RULES, Rule, catalog_df, read_catalog, read_rules, rules, rules_df

TEXTS = [
    "Patient John Doe SSN 123-45-6789 email john@example.com",
    "(555) 123-4567",
    "a(555) 123-4567",
    "é(555) 123-4567",
    "x 555-123-4567 and 555-123-4568, born 1/2/1980",
    "MRN: ABC-1234 MRN#9999999",
    "ü u@example.com ü 1/12/2020",
    "123-45-67890 1123-45-6789 123-45-6789",
    "",
    None,
]


def expected(text):
    """Brute force with Python's ASCII matching over UTF-8 bytes."""
    found = []
    for rule in CLINICAL_RULES:
        for m in re.finditer(rule.pattern.encode(), (text or "").encode()):
            found.append((rule.type, m.start(), m.end(), m[0].decode()))
    return found


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, note string")


def test_positions_match_brute_force(notes):
    rows = P.phi_positions(notes, "id", ["note"]).collect()
    for i, text in enumerate(TEXTS):
        got = [(r["type"], r["start"], r["end"], r["value"]) for r in rows if r["id"] == i]
        assert sorted(got) == sorted(expected(text)), text


def test_positions_of_very_many_matches(spark):
    text = "ü " + " ".join(f"u{i}@example.com" for i in range(3000))
    rows = P.phi_positions(spark.createDataFrame([(1, text)], "id int, t string"), "id", ["t"]).collect()
    assert sorted((r["type"], r["start"], r["end"], r["value"]) for r in rows) == sorted(expected(text))


def test_matches_and_summary(notes):
    rows = {r["id"]: r for r in P.phi_summary(notes, "id", ["note"]).collect()}
    assert rows[0]["phi_types"] == ["email", "ssn"] and rows[0]["confidence"] == 0.85
    assert not rows[1]["detected"], "a bracket at the start has no boundary on its left"
    assert rows[2]["detected"] and not rows[3]["detected"]
    assert rows[4]["confidence"] == 0.95
    assert rows[9]["match_count"] == 0 and rows[9]["confidence"] == 0


def test_nested_records_are_scanned(spark):
    row = spark.sql(
        "SELECT 1 AS id, named_struct('a', array('x 123-45-6789'), 'm', map('k', named_struct('t', 'u@ex.com')), "
        "'n', 12, 'z', CAST(NULL AS ARRAY<STRING>)) AS payload"
    )
    found = {(r["path"], r["type"]) for r in P.detect_phi(row, "id", ["payload"]).collect()}
    assert found == {("payload.a", "ssn"), ("payload.m.k.t", "email")}
    leaves = {(r["path"], r["text"]) for r in P.string_leaves(row, "id", ["payload"]).collect()}
    assert ("payload.n", "12") in leaves and len(leaves) == 3
    masked = P.mask_phi(row, ["payload"]).first()["payload"]
    assert masked["a"] == ["x ***-**-****"] and masked["m"]["k"]["t"] == "***@***" and masked["n"] == 12 and masked["z"] is None


def test_masking_leaves_no_match_and_is_stable(notes):
    once = P.mask_phi(notes, ["note"])
    twice = P.mask_phi(once, ["note"])
    assert once.collect() == twice.collect()
    assert P.detect_phi(once, "id", ["note"]).count() == 0


def test_skipping_by_needed_text_changes_nothing(notes):
    bare = [Rule(r.name, r.type, r.pattern, r.mask) for r in CLINICAL_RULES]
    assert P.mask_phi(notes, ["note"]).collect() == P.mask_phi(notes, ["note"], bare).collect()
    assert P.detect_phi(notes, "id", ["note"]).collect() == P.detect_phi(notes, "id", ["note"], bare).collect()


def test_a_mask_can_bring_what_a_later_rule_needs(spark):
    chain = [Rule("a", "a", "one", "two-2", needs="one"), Rule("b", "b", "two-2", "done", needs="-")]
    rows = spark.createDataFrame([("one",), ("other",)], "t string")
    assert [r["t"] for r in P.mask_phi(rows, ["t"], chain).collect()] == ["done", "other"]


@pytest.mark.parametrize("pattern", [r"\b\d?x", r"a\d*\b", r"\b\d{0,2}y", r"\bq\d{2}\b", r"z\d{0,1}\b"])
def test_boundaries_beside_digits(spark, pattern):
    texts = ["x", "1x ax é1x", "a1 a12é a", "y 1y é22y", "q12 q123 éq12", "z z1 z12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(F.regexp_extract_all("t", F.lit(P.ascii_pattern(pattern)), F.lit(0)).alias("v")).collect()
    assert [r["v"] for r in found] == [[m[0].decode() for m in re.finditer(pattern.encode(), t.encode())] for t in texts]


def test_tokens_hide_the_whole_text_and_come_back(spark, notes):
    hidden = P.tokenize(notes, ["note"], "salt")
    vault = P.vault_rows(notes, ["note"], "salt")
    assert {r["value"] for r in vault.collect()} == {t for t in TEXTS if expected(t)}
    back = {r["id"]: r["original"] for r in P.reidentify(hidden, vault, "note").collect()}
    assert back == {i: (t if expected(t) else None) for i, t in enumerate(TEXTS)}
    assert P.vault_rows(notes, ["note"], "salt", existing=vault).count() == 0


def test_no_rules_and_no_columns(notes):
    assert P.detect_phi(notes, "id", ["note"], []).count() == 0
    assert P.detect_phi(notes, "id", []).count() == 0
    assert P.tokenize(notes, ["note"], "s", []).collect() == notes.collect()
    assert P.mask_phi(notes, ["note"], []).collect() == notes.collect()


def test_a_value_found_in_one_field_hides_another(spark):
    row = spark.createDataFrame([("123-45-6789", "id=123-45-6789x", "free")], "a string, b string, c string")
    got = P.tokenize(row, ["a", "b", "c"], "s").first()
    assert got["a"].startswith("token_") and got["b"].startswith("token_") and got["c"] == "free"


def test_anonymity(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x"), (None, 3, "x"), (None, 3, "x")], "q string, r int, s string")
    report = P.anonymity_report(rows, ["q", "r"], "s").first()
    assert (report["group_count"], report["k"], report["l"], report["largest_group"]) == (3, 1, 1, 2)
    kept = P.suppress_small_groups(rows, ["q", "r"], 2).collect()
    assert sorted(str(r["q"]) for r in kept) == ["None", "None", "a", "a"]


def test_rules_and_catalog(spark, tmp_path):
    assert [r.type for r in rules()] == [r.type for r in DEFAULT_RULES]
    assert rules_df(spark).count() == 4 and catalog_df(spark).count() == 2
    with pytest.raises(ValueError):
        rules([])
    assert rules([Rule("off", "off", "x", "y", enabled=False)]) == []
    path = str(tmp_path / "rules")
    rules_df(spark, CLINICAL_RULES).write.json(path)
    assert {r.type for r in read_rules(spark, path)} == {r.type for r in CLINICAL_RULES}


def test_yaml_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text(
        'rules:\n  - {name: Ward, type: ward, pattern: "\\\\bW-\\\\d+", mask: "W", severity: low, enabled: true}\n'
        '  - {name: Off, type: off, pattern: "x", mask: "y", severity: low, enabled: false}\n'
    )
    (tmp_path / "terms.yaml").write_text('concepts:\n  spo2:\n    display: Saturation\n    loinc: "59408-5"\n')
    (tmp_path / "none.yaml").write_text("rules: []\nconcepts: {}\n")
    assert [(r.type, r.pattern) for r in read_rules(spark, str(tmp_path / "rules.yaml"))] == [("ward", r"\bW-\d+")]
    row = read_catalog(spark, str(tmp_path / "terms.yaml")).first()
    assert (row["concept"], row["loinc"], row["snomed"]) == ("spo2", "59408-5", "")
    for read in (read_rules, read_catalog):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "none.yaml"))


def test_a_mask_that_joins_text_is_seen_by_later_rules(spark):
    rules = [Rule("a", "A", r"#\d+#", ""), Rule("b", "B", r"MRN\d{3}", "MRN-***", needs="MRN")]
    assert masked(spark, "MR#1#N123", rules) == "MRN-***"


def test_masks_stand_for_themselves(spark):
    assert masked(spark, "id 42", [Rule("n", "N", r"\d+", "$1\\")]) == "id $1\\"


def masked(spark, text, rules):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(P.replace_all(F.col("text"), rules).alias("x")).first().x
