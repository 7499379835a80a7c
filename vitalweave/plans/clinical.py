"""Requests to canonical records, and records to masters."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.operators import ingest as V
from vitalweave.operators import linkage as L
from vitalweave.operators import normalize as N
from vitalweave.operators.match_index import MatchIndex, link_indexed
from vitalweave.plans.registry import Tables, clock, plan
from vitalweave.session import shared_dir
from vitalweave.sources.events import split_quarantine
from vitalweave.sources.reference_data import CLINICAL_CONCEPTS, catalog_df

VALID_SQL = """WITH x AS (SELECT id, lower(trim(source)) AS s, lower(trim(format)) AS f,
        coalesce(regexp_replace(data, '\\s+', '', 'g'), '') AS d FROM arrivals),
    checked AS (SELECT id, CASE
        WHEN coalesce(s, '') = '' THEN 'source required: invalid source'
        WHEN s NOT IN ('hospital', 'lab', 'imaging', 'wearable', 'telehealth') THEN concat('source ''', s, ''' not allowed: invalid source')
        WHEN coalesce(f, '') = '' THEN 'format required: invalid format'
        WHEN f NOT IN ('fhir', 'hl7', 'json', 'csv', 'dicom') THEN concat('format ''', f, ''' not supported: invalid format')
        WHEN d IN ('', '{}', 'null') THEN 'missing data payload' END AS reason FROM x)
    """


@plan("v1_validate_requests", VALID_SQL + "SELECT id, reason FROM checked", "arrivals")
def _(t: Tables):
    return V.validate_requests(t["arrivals"]).select("id", "reason")


@plan(
    "s3_split_quarantine",
    VALID_SQL + "SELECT id, reason, reason IS NULL AS kept FROM checked WHERE reason IS NOT NULL OR id IS NOT NULL",
    "arrivals",
)
def _(t: Tables):
    good, bad = split_quarantine(V.validate_requests(t["arrivals"]).select("id", "reason"))
    kept = good.select("id", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("kept"))
    return kept.unionByName(bad.withColumn("kept", F.lit(False)))


@plan(
    "v2_latest_status",
    "SELECT id, status, CASE WHEN status <> 'accepted' THEN error END AS error, CASE WHEN status = 'accepted' THEN created_at ELSE updated_at END AS at FROM requests",
    "requests",
)
def _(t: Tables):
    return V.latest_status(t["status_events"]).select("id", "status", "error", "at")


@plan("v3_retry_counts", "SELECT id, count(*) - 1 AS retry_count FROM attempts GROUP BY id", "attempts")
def _(t: Tables):
    return V.retry_counts(t["attempts"])


@plan(
    "v4_apply_retention",
    "SELECT id, created_at FROM requests WHERE created_at >= TIMESTAMP '1998-08-02 12:00:00' - INTERVAL '7' DAY",
    "requests",
)
def _(t: Tables):
    return V.apply_retention(t["requests"], clock("1998-08-02 12:00:00"), timedelta(days=7)).select("id", "created_at")


@plan(
    "v5_status_of",
    "SELECT id, status FROM requests WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "requests",
)
def _(t: Tables):
    asked = t["lineitem"].filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return V.status_of(t["requests"], asked).select("id", "status")


def payloads(t: Tables) -> DataFrame:
    return t["payloads"].withColumn("payload", F.from_json("payload_text", N.PAYLOAD))


@plan(
    "n1_select_payload",
    """SELECT id, CASE WHEN id % 4 <> 3 THEN payload_text ->> '$.resourceType' END AS resource_type,
       CASE WHEN id % 4 = 3 THEN 'tokenized data not present' END AS reason FROM payloads""",
    "payloads",
)
def _(t: Tables):
    text, kind = F.col("payload_text"), F.col("id") % 4
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    events = t["payloads"].select(
        "id",
        F.when(kind == 0, text).when(kind == 2, quoted).when(kind == 3, F.lit("none")).alias("tokenized_data"),
        F.when(kind == 1, text).alias("sanitized_data"),
    )
    return N.select_payload(events).select("id", F.col("payload.resourceType").alias("resource_type"), "reason")


@plan(
    "n2_route_resources",
    """WITH x AS (SELECT id, trim(payload_text ->> '$.resourceType') AS r FROM payloads)
       SELECT id, lower(r) AS resource_key, CASE WHEN lower(r) NOT IN ('observation', 'condition')
              THEN concat('resourceType ', r, ' not allowed') END AS reason FROM x""",
    "payloads",
)
def _(t: Tables):
    return N.route_resources(payloads(t), ["Observation ", "condition"]).select("id", "resource_key", "reason")


def present_sql(path: str) -> str:
    return f"nullif(trim(payload_text ->> '{path}'), '')"


OBSERVATION_SQL = f"""lower(coalesce({present_sql('$.code.text')}, {present_sql('$.code.display')}, {present_sql('$.concept')}, ''))"""
CONDITION_SQL = f"""lower(coalesce({present_sql('$.description')}, {present_sql('$.concept')}, {present_sql('$.code.text')}, ''))"""
PROCEDURE_SQL = f"""lower(coalesce({present_sql('$.description')}, {present_sql('$.code.text')}, ''))"""
KIND_SQL = "lower(trim(payload_text ->> '$.resourceType'))"
VALUE_SQL = "coalesce(payload_text ->> '$.valueQuantity.value', payload_text ->> '$.value')"
UNIT_SQL = "coalesce(payload_text ->> '$.valueQuantity.unit', payload_text ->> '$.unit')"
EFFECTIVE_SQL = f"coalesce({present_sql('$.effectiveDateTime')}, '')"
PATIENT_SQL = f"coalesce({present_sql('$.patient_id')}, regexp_extract({present_sql('$.subject.reference')}, '[^/]*$'), '')"
TIME_SQL = """CASE WHEN id % 10 = 0 THEN received_at
    ELSE CAST(concat('2024-02-', lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0'), ' 08:30:00') AS TIMESTAMP) END"""


@plan(
    "n3_canonical_observation",
    f"""SELECT id, {OBSERVATION_SQL} AS concept, {VALUE_SQL} AS value, {UNIT_SQL} AS unit, {EFFECTIVE_SQL} AS effective
        FROM payloads WHERE {KIND_SQL} = 'observation'""",
    "payloads",
)
def _(t: Tables):
    return N.canonical_observation(payloads(t))


@plan(
    "n4_canonical_condition",
    f"""SELECT id, {CONDITION_SQL} AS concept, coalesce({present_sql('$.recordedDate')}, '') AS recorded_date,
        coalesce({present_sql('$.clinicalStatus.text')}, '') AS clinical_status
        FROM payloads WHERE {KIND_SQL} = 'condition'""",
    "payloads",
)
def _(t: Tables):
    return N.canonical_condition(payloads(t))


@plan(
    "n5_canonical_procedure",
    f"""SELECT id, {PROCEDURE_SQL} AS concept, coalesce({present_sql('$.performedDateTime')}, '') AS performed
        FROM payloads WHERE {KIND_SQL} = 'procedure'""",
    "payloads",
)
def _(t: Tables):
    return N.canonical_procedure(payloads(t))


@plan("n6_patient_ref", f"SELECT id, {PATIENT_SQL} AS patient_id FROM payloads", "payloads")
def _(t: Tables):
    return payloads(t).select("id", N.patient_ref().alias("patient_id"))


@plan("n7_event_time", f"SELECT id, {TIME_SQL} AS timestamp FROM payloads", "payloads")
def _(t: Tables):
    return payloads(t).select("id", N.event_time("payload", F.col("received_at")).alias("timestamp"))


@plan(
    "n8_attach_codes",
    """SELECT f.id, nullif(c.snomed, '') AS snomed, CASE WHEN f.resource_type = 'Observation' THEN nullif(c.loinc, '') END AS loinc,
       nullif(c.icd10, '') AS icd10 FROM facts f
       LEFT JOIN catalog c ON c.concept = f.concept AND f.resource_type IN ('Observation', 'Condition')""",
    "facts",
    "catalog",
)
def _(t: Tables):
    shouted = t["facts"].select("id", "resource_type", F.upper("concept").alias("concept"))
    return N.attach_codes(shouted, catalog_df(t.spark, CLINICAL_CONCEPTS)).select("id", "snomed", "loinc", "icd10")


@plan(
    "n9_map_codes",
    """WITH long AS (SELECT concept, 'snomed' AS sys, snomed AS code FROM catalog UNION ALL SELECT concept, 'loinc', loinc FROM catalog
                     UNION ALL SELECT concept, 'icd10', icd10 FROM catalog)
       SELECT f.id, f.code_loinc AS code, t.sys AS target_system, t.code AS target_code
       FROM facts f JOIN long s ON s.sys = 'loinc' AND s.code = f.code_loinc AND s.code <> ''
       JOIN long t ON t.concept = s.concept AND t.sys IN ('snomed', 'icd10') AND t.code <> ''""",
    "facts",
    "catalog",
)
def _(t: Tables):
    asked = t["facts"].select("id", F.lit("LOINC").alias("system"), F.col("code_loinc").alias("code"))
    rows = N.map_codes(asked, catalog_df(t.spark, CLINICAL_CONCEPTS), ["SNOMED", "ICD10"])
    return rows.select("id", "code", "target_system", "target_code")


@plan(
    "n10_normalize",
    f"""WITH x AS (SELECT *, {KIND_SQL} AS k FROM payloads),
        y AS (SELECT *, CASE k WHEN 'observation' THEN {OBSERVATION_SQL} WHEN 'condition' THEN {CONDITION_SQL}
                               WHEN 'procedure' THEN {PROCEDURE_SQL} END AS concept FROM x)
        SELECT id, CASE WHEN y.concept IS NOT NULL THEN {PATIENT_SQL} END AS patient_id,
               CASE WHEN y.concept IS NOT NULL THEN concat(upper(substr(k, 1, 1)), substr(k, 2)) END AS resource_type,
               y.concept, CASE WHEN k = 'observation' THEN {VALUE_SQL} END AS value,
               CASE WHEN y.concept IS NOT NULL THEN {TIME_SQL} END AS timestamp,
               CASE WHEN y.concept IS NULL THEN concat('resourceType ', trim(payload_text ->> '$.resourceType'), ' not allowed') END AS reason,
               nullif(c.snomed, '') AS snomed, CASE WHEN k = 'observation' THEN nullif(c.loinc, '') END AS loinc
        FROM y LEFT JOIN catalog c ON c.concept = y.concept AND k IN ('observation', 'condition')""",
    "payloads",
    "catalog",
)
def _(t: Tables):
    rows = N.normalize(payloads(t), catalog_df(t.spark, CLINICAL_CONCEPTS))
    return rows.select(
        "id", "patient_id", "resource_type", "concept", "value", "timestamp", "reason", "snomed", "loinc"
    )


LINK_FIELDS = ("patient_id", "mrn")
KEYED_SQL = """WITH keyed AS (SELECT *, CASE WHEN trim(patient_id) <> '' THEN concat('patient_id:', lower(trim(patient_id)))
                                     WHEN trim(mrn) <> '' THEN concat('mrn:', lower(trim(mrn))) END AS link_key FROM link_input),
    known AS (SELECT deterministic_key AS link_key, max_by(master_id, row(created_at, id)) AS known_master FROM links GROUP BY 1),
    linked AS (SELECT k.*, CASE WHEN k.link_key IS NOT NULL
                    THEN coalesce(known_master, concat('master-', substr(sha256(k.link_key), 1, 16))) END AS master_id,
               CASE WHEN k.link_key IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS score,
               CASE WHEN k.link_key IS NOT NULL THEN 'deterministic' END AS method,
               k.link_key IS NOT NULL AND known_master IS NULL AS is_new
               FROM keyed k LEFT JOIN known USING (link_key))
    """


@plan("l1_deterministic_key", KEYED_SQL + "SELECT id, link_key FROM keyed", "link_input", "links")
def _(t: Tables):
    return L.deterministic_key(t["link_input"], LINK_FIELDS).select("id", "link_key")


@plan(
    "l2_link_deterministic",
    KEYED_SQL + "SELECT id, link_key, master_id, score, method, is_new FROM linked",
    "link_input",
    "links",
)
def _(t: Tables):
    keyed = L.deterministic_key(t["link_input"], LINK_FIELDS)
    rows = L.link_deterministic(keyed, t["links"])
    return rows.select("id", "link_key", "master_id", "score", "method", "is_new")


BEST_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY inc_id ORDER BY score DESC, ref) AS n FROM scored WHERE score >= 0.85)
    SELECT i.inc_id, CAST(r.ref AS VARCHAR) AS {0}, coalesce(r.score, 1.0) AS score,
           CASE WHEN r.inc_id IS NULL THEN 'new' ELSE 'probabilistic' END AS method
    FROM incoming i LEFT JOIN ranked r ON r.inc_id = i.inc_id AND r.n = 1"""


@plan(
    "l3_link_probabilistic",
    """WITH scored AS (SELECT i.inc_id, r.reg_id AS ref, round(jaro_winkler_similarity(r.patient_id, trim(i.patient_id)), 10) AS score
                       FROM incoming i JOIN registry r ON r.block = i.block),
       """
    + BEST_SQL.format("reg_id"),
    "incoming",
    "registry",
)
def _(t: Tables):
    rows = L.link_probabilistic(t["incoming"], t["registry"], "block")
    return rows.select("inc_id", F.col("reg_id").cast("string").alias("reg_id"), "score", "method")


@plan(
    "l3_link_recent",
    """WITH newest AS (SELECT * FROM links ORDER BY created_at DESC, id DESC LIMIT 100),
       scored AS (SELECT i.inc_id, c.master_id AS ref, round(jaro_winkler_similarity(c.patient_id, trim(i.patient_id)), 10) AS score
                  FROM incoming i CROSS JOIN newest c),
       """
    + BEST_SQL.format("master_id"),
    "incoming",
    "links",
)
def _(t: Tables):
    return L.link_recent(t["incoming"], t["links"]).select("inc_id", "master_id", "score", "method")


@plan(
    "l4_recent_links",
    "SELECT id, master_id, patient_id, created_at FROM links ORDER BY created_at DESC, id DESC LIMIT 100",
    "links",
)
def _(t: Tables):
    return L.recent_links(t["links"]).select("id", "master_id", "patient_id", "created_at")


@plan(
    "l5_link_rows",
    KEYED_SQL
    + """SELECT sha256(concat(master_id, '|', CAST(id AS VARCHAR))) AS id, master_id, patient_id, link_key AS deterministic_key,
                score, method, concat('{"mrn":"', mrn, '"}') AS attributes, TIMESTAMP '2024-01-31 00:00:00' AS created_at
         FROM linked WHERE link_key IS NOT NULL AND mrn IS NOT NULL""",
    "link_input",
    "links",
)
def _(t: Tables):
    keyed = L.deterministic_key(t["link_input"], LINK_FIELDS)
    linked = L.link_deterministic(keyed, t["links"]).filter("link_key IS NOT NULL AND mrn IS NOT NULL")
    return L.link_rows(linked.withColumn("timestamp", clock("2024-01-31 00:00:00")), ["mrn"])


@plan(
    "l6_links_for",
    """SELECT id, patient_id, master_id, created_at FROM (
       SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) AS n FROM links
       WHERE patient_id IN (SELECT patient_id FROM registry WHERE patient_id LIKE '%-building')) x WHERE n <= 5""",
    "links",
    "registry",
)
def _(t: Tables):
    asked = t["registry"].filter("patient_id LIKE '%-building'")
    return L.links_for(t["links"], asked, 5).select("id", "patient_id", "master_id", "created_at")


@plan(
    "l7_linkage_summary",
    """WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) AS n FROM links) x
                       WHERE n <= 25)
       SELECT patient_id, max_by(master_id, row(created_at, id)) AS master_id, max_by(score, row(created_at, id)) AS primary_score,
              max_by(method, row(created_at, id)) AS method, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS linked
       FROM newest GROUP BY patient_id""",
    "links",
)
def _(t: Tables):
    rows = L.linkage_summary(t["links"])
    ids = F.transform("linked_patients", lambda p: p["id"].cast("string"))
    return rows.select("patient_id", "master_id", "primary_score", "method", F.array_join(ids, ",").alias("linked"))


def indexed(t: Tables, registry: DataFrame, incoming: DataFrame, block: str, ref: str) -> DataFrame:
    index = MatchIndex.build(registry, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}", block, "patient_id", ref)
    return link_indexed(incoming, index, block, ref=ref)


@plan(
    "l3_link_indexed",
    """WITH scored AS (SELECT i.inc_id, CAST(r.reg_id AS VARCHAR) AS ref, round(jaro_winkler_similarity(r.patient_id, trim(i.patient_id)), 10) AS score
                       FROM incoming i JOIN registry r ON r.block = i.block),
       """
    + BEST_SQL.format("reg_id"),
    "incoming",
    "registry",
)
def _(t: Tables):
    return indexed(t, t["registry"], t["incoming"], "block", "reg_id").select("inc_id", "reg_id", "score", "method")


@plan(
    "l3_link_all_links",
    """WITH known AS (SELECT DISTINCT split_part(patient_id, '-', 3) AS block, patient_id, master_id FROM links),
       scored AS (SELECT i.inc_id, c.master_id AS ref, round(jaro_winkler_similarity(c.patient_id, trim(i.patient_id)), 10) AS score
                  FROM incoming i JOIN known c ON c.block = split_part(lower(trim(i.patient_id)), '-', 3)),
       """
    + BEST_SQL.format("master_id"),
    "incoming",
    "links",
)
def _(t: Tables):
    block = F.split_part(F.lower(F.trim("patient_id")), F.lit("-"), F.lit(3))
    links, incoming = (t[name].withColumn("block", block) for name in ("links", "incoming"))
    return indexed(t, links, incoming, "block", "master_id").select("inc_id", "master_id", "score", "method")
