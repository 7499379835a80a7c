import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitalweave.operators import ingest as V
from vitalweave.operators import normalize as N
from vitalweave.sources.reference_data import CLINICAL_CONCEPTS, Concept, catalog_df, read_catalog


def parsed(spark, *documents):
    rows = spark.createDataFrame(
        [(i, json.dumps(d), datetime(2024, 1, 1)) for i, d in enumerate(documents)], "id int, t string, received_at timestamp_ntz"
    )
    return rows.withColumn("payload", F.from_json("t", N.PAYLOAD))


def test_first_failed_check_gives_the_reason(spark):
    rows = spark.createDataFrame(
        [
            (" Hospital", "FHIR ", '{"a": 1}'),
            (None, "bad", ""),
            ("ward", "bad", ""),
            ("lab", " ", ""),
            ("lab", "xml", ""),
            ("lab", "hl7", "{ }"),
            ("lab", "hl7", None),
        ],
        "source string, format string, data string",
    )
    assert [r["reason"] for r in V.validate_requests(rows).collect()] == [
        None,
        "source required: invalid source",
        "source 'ward' not allowed: invalid source",
        "format required: invalid format",
        "format 'xml' not supported: invalid format",
        "missing data payload",
        "missing data payload",
    ]
    open_lists = V.validate_requests(rows, [], [])
    assert [r["reason"] for r in open_lists.collect()][2] == "missing data payload"


def test_empty_maps_are_missing_data(spark):
    rows = spark.sql("SELECT 'lab' source, 'csv' format, map() data UNION ALL SELECT 'lab', 'csv', map('a', 'b')")
    assert [r["reason"] for r in V.validate_requests(rows).collect()] == ["missing data payload", None]


def test_retention(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 9)], "created_at timestamp_ntz")
    now = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    assert V.apply_retention(rows, now).count() == 2
    assert V.apply_retention(rows, now, timedelta(0)).count() == 3


def test_payload_sources_in_order(spark):
    document = '{"resourceType": "Observation"}'
    rows = spark.createDataFrame(
        [(document, '{"resourceType": "Other"}'), (None, document), (json.dumps(document), None), ("text", None), (None, None)],
        "tokenized_data string, sanitized_data string",
    )
    got = N.select_payload(rows).select("payload.resourceType", "reason").collect()
    assert [r[0] for r in got] == ["Observation"] * 3 + [None, None]
    assert [r[1] for r in got] == [None] * 3 + ["tokenized data not present"] * 2


def test_canonical_forms(spark):
    rows = parsed(
        spark,
        {"resourceType": "OBSERVATION", "patient_id": " p1 ", "code": {"text": " ", "display": "Heart-Rate "}, "value": 1,
         "valueQuantity": {"value": 61.5, "unit": "bpm"}, "effectiveDateTime": "2024-01-02T03:04:05Z"},
        {"resourceType": "observation", "subject": {"reference": "urn/x/Patient/9"}, "concept": "Blood-Glucose", "value": "118/76"},
        {"resourceType": "Condition", "subject": {"reference": "Patient/123"}, "description": "Diagnosis-Diabetes",
         "clinicalStatus": {"text": "active"}, "recordedDate": "2024-01-01"},
        {"resourceType": "procedure", "code": {"text": "Blood-Glucose"}, "performedDateTime": "2024"},
        {"resourceType": "Encounter"},
        {"patient_id": "x"},
    )
    got = {r["id"]: r for r in N.normalize(rows, catalog_df(spark, CLINICAL_CONCEPTS)).collect()}
    first = got[0]
    assert (first["patient_id"], first["concept"], first["value"], first["unit"]) == ("p1", "heart-rate", "61.5", "bpm")
    assert first["timestamp"] == datetime(2024, 1, 2, 3, 4, 5) and first["resource_type"] == "Observation"
    assert (first["snomed"], first["loinc"], first["icd10"]) == ("364075005", "8867-4", "R00.8")
    assert got[1]["patient_id"] == "9" and got[1]["value"] == "118/76" and got[1]["timestamp"] == datetime(2024, 1, 1)
    assert got[2]["patient_id"] == "123" and got[2]["loinc"] is None and got[2]["icd10"] == "E11.9"
    assert got[3]["snomed"] is None and got[3]["performed"] == "2024" and got[3]["patient_id"] == ""
    assert got[4]["reason"] == "resourceType Encounter not allowed"
    assert got[5]["reason"] == "resourceType missing"
    open_list = {r["id"]: r["reason"] for r in N.route_resources(rows, []).collect()}
    assert open_list[4] == "resourceType Encounter unsupported"


def test_codes_map_omits_empty_codes(spark):
    rows = spark.createDataFrame([("Condition", "DIAGNOSIS-diabetes"), ("Procedure", "blood-glucose")], "resource_type string, concept string")
    coded = N.attach_codes(rows, catalog_df(spark, CLINICAL_CONCEPTS))
    got = {r["resource_type"]: r["codes"] for r in coded.select("resource_type", N.codes_map(coded).alias("codes")).collect()}
    assert got == {"Condition": {"SNOMED": "44054006", "ICD10": "E11.9"}, "Procedure": {}}


def test_routing_reads_the_payload_once(spark, capsys):
    N.normalize(parsed(spark, {"resourceType": "Observation"}), catalog_df(spark)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Python" not in plan


@pytest.mark.parametrize("reference, expected", [("Patient/123", "123"), ("urn/x/Patient/9", "9"), (None, "")])
def test_patient_reference(spark, reference, expected):
    rows = parsed(spark, {"subject": {"reference": reference}})
    assert rows.select(N.patient_ref().alias("p")).first()["p"] == expected


def test_concepts_that_differ_in_case_give_one_fact(spark, tmp_path):
    rows = [Concept("a", "A", "1", "2", "3"), Concept("A", "other", "9", "9", "9")]
    records = spark.createDataFrame([("1", "Observation", "A")], "id string, resource_type string, concept string")
    found = N.attach_codes(records, catalog_df(spark, rows)).collect()
    assert [(r.snomed, r.loinc) for r in found] == [("1", "2")]
    path = tmp_path / "catalog.json"
    path.write_text("\n".join('{"concept":"%s","display":"x","snomed":"%s"}' % x for x in (("b", "2"), ("B", "1"))))
    assert read_catalog(spark, str(path)).count() == 1
