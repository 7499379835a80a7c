"""Clinical input tables derived from the given Parquet tables.

Each statement runs unchanged on Spark and on an ANSI engine that has the tables as
views; names in braces are given tables or other statements of this module.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vitalweave.sources.tables import read_table

PATIENT = "concat('patient-', lpad(CAST({key} AS VARCHAR(20)), 6, '0'))"
TYPE = "CASE event_type WHEN 'error' THEN 'Condition' WHEN 'signup' THEN 'Procedure' ELSE 'Observation' END"
CONCEPT = (
    "CASE event_type WHEN 'click' THEN 'heart-rate' WHEN 'view' THEN 'blood-glucose' "
    "WHEN 'purchase' THEN 'blood-pressure' WHEN 'error' THEN 'diagnosis-diabetes' ELSE 'intake-visit' END"
)
UNIT = "CASE event_type WHEN 'click' THEN 'bpm' WHEN 'view' THEN 'mg/dL' WHEN 'purchase' THEN 'mmHg' END"
EVENT_PATIENT = PATIENT.format(key="user_id")
CUSTOMER_PATIENT = PATIENT.format(key="c_custkey")
ORDER_SOURCE = (
    "CASE o_custkey % 5 WHEN 0 THEN 'hospital' WHEN 1 THEN 'lab' WHEN 2 THEN 'imaging' "
    "WHEN 3 THEN 'wearable' ELSE 'telehealth' END"
)

STATEMENTS = {
    "facts": f"""
SELECT event_id AS id,
       {EVENT_PATIENT} AS patient_id,
       concat('master-', CAST(user_id % 1000 AS VARCHAR(20))) AS master_id,
       concat('tenant-', CAST(user_id % 4 AS VARCHAR(20))) AS tenant_id,
       {TYPE} AS resource_type,
       {CONCEPT} AS concept,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value,
       {UNIT} AS unit,
       CASE event_type WHEN 'click' THEN '8867-4' WHEN 'view' THEN '2339-0' WHEN 'purchase' THEN '85354-9' END AS code_loinc,
       CASE event_type WHEN 'click' THEN '364075005' WHEN 'view' THEN '271062007'
                       WHEN 'purchase' THEN '75367002' WHEN 'error' THEN '44054006' END AS code_snomed,
       ts AS timestamp
FROM {{events}}""",
    # The same facts with loosely typed values: blood pressure as text pairs, some blanks and units.
    "mixed_facts": """
SELECT id, patient_id, master_id, tenant_id, resource_type, concept,
       CASE WHEN value IS NULL THEN NULL
            WHEN concept = 'blood-pressure' THEN concat(CAST(value AS VARCHAR(20)), '/76')
            WHEN id % 17 = 0 THEN ''
            WHEN id % 13 = 0 THEN concat(' ', CAST(value AS VARCHAR(20)), ' ')
            WHEN id % 11 = 0 THEN concat(CAST(value AS VARCHAR(20)), 'd')
            ELSE CAST(value AS VARCHAR(20)) END AS value,
       unit, timestamp
FROM {facts}""",
    "catalog": """
SELECT * FROM (VALUES
  ('blood-glucose', 'Blood Glucose', '271062007', '2339-0', 'R73.9'),
  ('blood-pressure', 'Blood Pressure', '75367002', '85354-9', 'I10'),
  ('heart-rate', 'Heart rate', '364075005', '8867-4', 'R00.8'),
  ('diagnosis-diabetes', 'Type 2 diabetes mellitus', '44054006', '', 'E11.9'))
  AS t(concept, display, snomed, loinc, icd10)""",
    "requests": f"""
SELECT o_orderkey AS id,
       {ORDER_SOURCE} AS source,
       CASE o_orderkey % 6 WHEN 0 THEN 'fhir' WHEN 1 THEN 'HL7 ' WHEN 2 THEN 'json'
                           WHEN 3 THEN 'csv' WHEN 4 THEN 'dicom' ELSE 'notes' END AS format,
       CASE o_orderstatus WHEN 'P' THEN 'published' WHEN 'O' THEN 'accepted' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN
            CASE o_orderpriority WHEN '1-URGENT' THEN 'broker timeout' WHEN '2-HIGH' THEN ' broker timeout '
                                 WHEN '3-MEDIUM' THEN 'schema rejected' WHEN '5-LOW' THEN '   ' END END AS error,
       CASE o_orderkey % 4 WHEN 0 THEN '{{{{}}}}' WHEN 1 THEN 'not json'
            ELSE concat('{{{{"order":', CAST(o_orderkey AS VARCHAR(20)), '}}}}') END AS payload,
       CAST(o_orderkey % 3 AS INTEGER) AS retry_count,
       o_orderdate AS created_at,
       o_orderdate + INTERVAL '90' SECOND AS updated_at
FROM {{orders}}""",
    # Requests as they arrive: sources and formats with blanks, case and unknown names.
    "arrivals": f"""
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 31 = 0 THEN '  ' WHEN o_orderkey % 29 = 0 THEN 'Pharmacy'
            ELSE concat(' ', upper({ORDER_SOURCE})) END AS source,
       CASE o_orderkey % 7 WHEN 0 THEN 'fhir' WHEN 1 THEN 'HL7 ' WHEN 2 THEN 'json' WHEN 3 THEN 'csv'
                           WHEN 4 THEN 'dicom' WHEN 5 THEN 'notes' ELSE NULL END AS format,
       CASE o_orderkey % 5 WHEN 0 THEN '{{{{ }}}}' WHEN 1 THEN NULL
            ELSE concat('{{{{"order":', CAST(o_orderkey AS VARCHAR(20)), '}}}}') END AS data
FROM {{orders}}""",
    "status_events": """
SELECT id, 'accepted' AS status, CAST(NULL AS VARCHAR(20)) AS error, created_at AS at, 0 AS seq FROM {requests}
UNION ALL
SELECT id, status, error, updated_at AS at, 1 AS seq FROM {requests} WHERE status <> 'accepted'""",
    "attempts": "SELECT l_orderkey AS id, l_linenumber AS attempt FROM {lineitem}",
    "phi_notes": f"""
SELECT c_custkey AS record_id,
       {CUSTOMER_PATIENT} AS patient_id,
       concat('Seen by ', c_name,
         CASE WHEN c_custkey % 2 = 0 THEN concat(' SSN 900-12-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) ELSE '' END,
         CASE WHEN c_custkey % 3 = 0 THEN concat(' born 1/', CAST(1 + c_custkey % 28 AS VARCHAR(20)), '/1970') ELSE '' END,
         CASE WHEN c_custkey % 5 = 0 THEN concat(' mail u', CAST(c_custkey AS VARCHAR(20)), '@example.com') ELSE '' END,
         CASE WHEN c_custkey % 7 = 0 THEN concat(' call 555-010-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) ELSE '' END,
         CASE WHEN c_custkey % 11 = 0 THEN concat(' MRN: A', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) ELSE '' END) AS note
FROM {{customer}}""",
    # Notes with a contact beside them, for records of more than one column.
    "phi_records": """
SELECT record_id, patient_id, note,
       CASE WHEN record_id % 5 = 0 THEN concat('reach u', CAST(record_id AS VARCHAR(20)), '@example.com today')
            WHEN record_id % 9 = 0 THEN concat('ü 555-010-', lpad(CAST(record_id % 10000 AS VARCHAR(20)), 4, '0'))
            ELSE 'none' END AS contact,
       record_id * 10 AS visits
FROM {phi_notes}""",
    "payloads": f"""
SELECT event_id AS id,
       concat('{{{{"resourceType":"', CASE event_type WHEN 'error' THEN 'Condition' WHEN 'signup' THEN 'procedure' ELSE 'Observation' END,
         CASE WHEN event_id % 19 = 0 THEN 'X' ELSE '' END, '",',
         CASE WHEN event_id % 3 = 0 THEN concat('"patient_id":" ', {EVENT_PATIENT}, ' ",')
              ELSE concat('"subject":{{{{"reference":"urn/x/Patient/', {EVENT_PATIENT}, '"}}}},') END,
         CASE WHEN event_type IN ('error', 'signup') THEN concat('"description":" ', upper({CONCEPT}), '",')
              WHEN event_id % 2 = 0 THEN concat('"code":{{{{"text":"', upper({CONCEPT}), '"}}}},')
              ELSE concat('"code":{{{{"display":"', {CONCEPT}, '"}}}},') END,
         CASE WHEN event_type IN ('error', 'signup') THEN '"clinicalStatus":{{{{"text":"active"}}}},"recordedDate":"2024-01-05",'
              WHEN event_id % 4 = 0 THEN concat('"value":"', CAST(value AS VARCHAR(20)), '/76","unit":"raw",')
              ELSE concat('"valueQuantity":{{{{"value":', CAST(value AS VARCHAR(20)), ',"unit":"mmHg"}}}},') END,
         CASE WHEN event_id % 10 = 0 THEN '"effectiveDateTime":"soon"'
              ELSE concat('"effectiveDateTime":"2024-02-', lpad(CAST(1 + event_id % 28 AS VARCHAR(20)), 2, '0'), 'T10:30:00+02:00"') END,
         '}}}}') AS payload_text,
       ts AS received_at
FROM {{events}}""",
    "registry": """
SELECT c_custkey AS reg_id, c_nationkey AS block,
       concat('pat-', lpad(CAST((c_custkey * 7919) % 1000003 AS VARCHAR(20)), 7, '0'), '-', lower(c_mktsegment)) AS patient_id
FROM {customer}""",
    "incoming": """
SELECT reg_id AS inc_id, block,
       CASE WHEN reg_id % 20 = 0 THEN concat('  ', upper(patient_id), ' ')
            ELSE concat(substr(patient_id, 1, 9), substr(patient_id, 11, 1), substr(patient_id, 10, 1), substr(patient_id, 12)) END AS patient_id
FROM {registry}""",
    # Records to link by key: some without a patient id, some with neither field.
    "link_input": """
SELECT inc_id AS id,
       CASE WHEN inc_id % 30 = 0 THEN '  ' ELSE patient_id END AS patient_id,
       CASE WHEN inc_id % 60 = 0 THEN NULL ELSE concat(' MRN', CAST(inc_id AS VARCHAR(20))) END AS mrn
FROM {incoming}""",
    "links": """
SELECT o.o_orderkey AS id,
       concat('m-', CAST(r.reg_id AS VARCHAR(20)), '-', CAST(o.o_orderkey % 2 AS VARCHAR(20))) AS master_id,
       r.patient_id AS patient_id,
       concat('patient_id:', r.patient_id) AS deterministic_key,
       CAST(CASE WHEN o.o_orderstatus = 'F' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS score,
       CASE WHEN o.o_orderstatus = 'F' THEN 'probabilistic' ELSE 'deterministic' END AS method,
       o.o_orderpriority AS attributes,
       o.o_orderdate AS created_at
FROM {orders} o JOIN {registry} r ON r.reg_id = o.o_custkey""",
    # Known patients of a tenant, each with a record number.
    "clinic_links": """
SELECT reg_id AS id, concat('m-', CAST(reg_id AS VARCHAR(20))) AS master_id, patient_id,
       concat('tenant-', CAST(block % 4 AS VARCHAR(20))) AS tenant_id,
       concat('mrn:r', lpad(CAST(reg_id AS VARCHAR(20)), 6, '0')) AS deterministic_key
FROM {registry}""",
    # Visits of these patients: a third with the record number, a third with a slip in the name, some walk-ins and blanks.
    "clinic_visits": f"""
SELECT e.event_id AS id, r.reg_id, concat('tenant-', CAST(r.block % 4 AS VARCHAR(20))) AS tenant_id,
       CASE WHEN e.event_id % 3 = 0 THEN concat('R', lpad(CAST(r.reg_id AS VARCHAR(20)), 6, '0')) END AS mrn,
       CASE WHEN e.event_id % 31 = 7 THEN concat('walk-in ', CAST(e.event_id % 5 AS VARCHAR(20)))
            WHEN e.event_id % 37 = 2 THEN ''
            WHEN e.event_id % 3 = 1 THEN concat(substr(r.patient_id, 1, 9), substr(r.patient_id, 11, 1), substr(r.patient_id, 10, 1), substr(r.patient_id, 12))
            ELSE r.patient_id END AS patient,
       CASE WHEN e.event_id % 19 = 0 THEN 'ObservationX' ELSE 'Observation' END AS kind,
       {CONCEPT} AS concept, e.value AS value, 1 + e.event_id % 28 AS day, e.ts AS received_at
FROM {{events}} e JOIN {{registry}} r ON r.reg_id = 1 + e.user_id % 150""",
    "clinic_payloads": """
SELECT id, concat('{{"resourceType":"', kind, '","tenant_id":"', tenant_id, '",',
         CASE WHEN mrn IS NULL THEN '' ELSE concat('"mrn":"', mrn, '",') END,
         '"patient_id":"', patient, '","code":{{"text":"', concept, '"}},"valueQuantity":{{"value":', CAST(value AS VARCHAR(20)),
         ',"unit":"u"}},"effectiveDateTime":"2024-02-', lpad(CAST(day AS VARCHAR(20)), 2, '0'), 'T10:30:00Z"}}') AS payload_text, received_at
FROM {clinic_visits}""",
    "prediction_logs": f"""
SELECT event_id AS id, {EVENT_PATIENT} AS patient_id,
       event_type AS model_name, value AS latency_ms, value / 500.0 AS confidence, ts AS created_at
FROM {{events}}""",
    "subjects": """
SELECT c_custkey AS subject_id, c_nationkey AS study_id, c_custkey % 7 AS site_id, c_name AS subject_code,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'enrolled' WHEN 'AUTOMOBILE' THEN 'active'
                         WHEN 'MACHINERY' THEN 'randomized' WHEN 'HOUSEHOLD' THEN 'screening'
                         ELSE 'withdrawn' END AS status
FROM {customer}""",
    "studies": """
SELECT n_nationkey AS study_id, n_name AS code,
       CASE n_nationkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'enrolling' ELSE 'closed' END AS status
FROM {nation}""",
    "study_dates": """
SELECT s.study_id, s.code, s.status, min(o.o_orderdate) AS created_at
FROM {studies} s JOIN {customer} c ON c.c_nationkey = s.study_id JOIN {orders} o ON o.o_custkey = c.c_custkey
GROUP BY s.study_id, s.code, s.status""",
    "sites": "SELECT s_suppkey AS site_id, s_nationkey AS study_id, s_name AS name FROM {supplier}",
    "form_submissions": """
SELECT p_partkey AS form_id, CAST(p_partkey % 25 AS INTEGER) AS study_id, lower(p_type) AS slug, p_name AS name,
       p_partkey AS submitted_seq
FROM {part}""",
    "visits": """
SELECT p_partkey AS visit_id, CAST(p_partkey % 25 AS INTEGER) AS study_id, p_name AS name, p_size AS visit_order,
       CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS required
FROM {part}""",
    "signatures": """
SELECT o_orderkey AS signature_id, o_custkey AS subject_id, o_orderdate AS signed_at,
       o_orderdate + INTERVAL '1' HOUR AS recorded_at
FROM {orders}""",
    "consent_versions": """
SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INTEGER) AS study_id,
       concat('v', CAST(o_orderkey % 100 AS VARCHAR(20))) AS version, o_orderdate AS effective_at
FROM {orders}""",
    "subject_dates": """
SELECT s.subject_id, s.study_id, s.subject_code, min(o.o_orderdate) AS created_at
FROM {subjects} s JOIN {orders} o ON o.o_custkey = s.subject_id GROUP BY s.subject_id, s.study_id, s.subject_code""",
    "audit_events": """
SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id % 25 AS INTEGER) END AS study_id,
       CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('user-', CAST(user_id AS VARCHAR(20))) END AS actor,
       event_type AS action, ts AS created_at
FROM {events}""",
    "study_changes": """
SELECT CAST(user_id % 25 AS INTEGER) AS study_id,
       CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'enrolling' ELSE 'closed' END AS status,
       ts AS at, event_id AS seq
FROM {events}""",
    "jobs": """
SELECT o_orderkey AS id,
       CASE o_custkey % 3 WHEN 0 THEN 'risk-score' WHEN 1 THEN 'readmission' ELSE 'triage' END AS model_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
       CASE o_orderkey % 4 WHEN 2 THEN concat('{{"accuracy":0.', CAST(100 + o_orderkey % 900 AS VARCHAR(20)), ',"loss":"0.',
                                              CAST(100 + o_orderkey % 800 AS VARCHAR(20)), '"}}')
                           WHEN 3 THEN '{{"accuracy":"","loss":""}}' END AS metrics,
       o_orderkey % 8 = 2 AS promoted,
       o_orderdate AS created_at
FROM {orders}""",
    "promotions": """
SELECT l_orderkey AS job_id, l_returnflag <> 'R' AS promoted, l_shipdate AS at,
       CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq
FROM {lineitem}""",
    "model_rows": """
SELECT CAST(id AS VARCHAR(20)) AS job_id, model_type, 'logistic_regression' AS algorithm,
       CAST(-1.5 - id % 7 AS DOUBLE) AS bias, CAST(0.01 * (id % 11) AS DOUBLE) AS coefficient, created_at
FROM {jobs} WHERE status = 'completed'""",
    "tenant_jobs": """
SELECT o_orderkey AS id, concat('cohort-', CAST(o_custkey % 40 AS VARCHAR(20))) AS cohort_id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('tenant-', CAST(o_orderkey % 4 AS VARCHAR(20))) END AS tenant_id,
       CASE o_orderstatus WHEN 'P' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       o_orderdate AS created_at
FROM {orders}""",
    "room_log": """
SELECT o_orderkey AS query_id, concat('owner-', CAST(o_custkey % 10 AS VARCHAR(20))) AS owner,
       CAST(0.05 * (1 + o_orderkey % 4) AS DOUBLE) AS epsilon, o_orderdate AS asked_at,
       concat('facts,site-', CAST(o_custkey % 7 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ',labs' ELSE '' END) AS source_list
FROM {orders}""",
    # Queries of which some ask for most of a budget.
    "asks": """
SELECT query_id, concat(owner, '-', CAST(query_id % 8 AS VARCHAR(20))) AS owner, asked_at,
       CASE WHEN query_id % 11 = 0 THEN CAST(7.5 AS DOUBLE) ELSE epsilon END AS epsilon FROM {room_log}""",
    # A saved cohort of each supplier: a text clause, bounds of the value and, for some, a time.
    "cohort_clauses": """
SELECT concat('cohort-', CAST(s_suppkey AS VARCHAR(20))) AS cohort_id, 'concept' AS field,
       CASE s_suppkey % 4 WHEN 0 THEN '=' WHEN 1 THEN 'in' WHEN 2 THEN '!=' ELSE '>=' END AS op,
       CASE s_suppkey % 4 WHEN 0 THEN 'Heart-Rate' WHEN 1 THEN '(heart-rate,blood-glucose)' WHEN 2 THEN 'blood-pressure' ELSE 'blood-pressure' END AS value
FROM {supplier} WHERE s_suppkey % 7 <> 3
UNION ALL
SELECT concat('cohort-', CAST(s_suppkey AS VARCHAR(20))), 'value', CASE s_suppkey % 3 WHEN 0 THEN '>=' WHEN 1 THEN '>' ELSE '<' END,
       CAST(s_suppkey % 97 + 0.5 AS VARCHAR(20)) FROM {supplier}
UNION ALL
SELECT concat('cohort-', CAST(s_suppkey AS VARCHAR(20))), 'value', '<=', CAST(s_suppkey % 97 + 20 AS VARCHAR(20)) FROM {supplier} WHERE s_suppkey % 5 <> 0
UNION ALL
SELECT concat('cohort-', CAST(s_suppkey AS VARCHAR(20))), 'timestamp', '>=', concat('2024-01-', lpad(CAST(1 + s_suppkey % 28 AS VARCHAR(20)), 2, '0'))
FROM {supplier} WHERE s_suppkey % 6 = 0""",
    # Each intake visit links the patient to a master.
    "fact_links": """
SELECT id, concat(master_id, '-', CAST(id % 3 AS VARCHAR(20))) AS master_id, patient_id,
       CAST(0.9 AS DOUBLE) AS score, concat('method-', CAST(id % 2 AS VARCHAR(20))) AS method,
       tenant_id AS attributes, timestamp AS created_at
FROM {facts} WHERE resource_type = 'Procedure'""",
    "offline_features": """
SELECT patient_id AS entity_id, id AS version, concept, value, timestamp AS created_at, id AS source_id FROM {facts}""",
}


def _names(name: str) -> list[str]:
    bare = STATEMENTS[name].replace("{{", "").replace("}}", "")
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", bare)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one when ``name`` is no statement."""
    if name not in STATEMENTS:
        return read_table(spark, name, sf_dir)
    return spark.sql(STATEMENTS[name], **{n: load(spark, sf_dir, n) for n in _names(name)})


def with_clause(*names: str) -> str:
    """``WITH`` list that defines the named statements, each after those it needs."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        needed = _names(name)
        for other in needed:
            if other in STATEMENTS and other not in parts:
                add(other)
        parts[name] = STATEMENTS[name].format(**{n: n for n in needed})

    for name in names:
        if name not in parts:
            add(name)
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
