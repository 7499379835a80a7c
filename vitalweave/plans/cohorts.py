"""Cohort queries, drill-down, materialization, rollups and export."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.ranges import PagedTable, page_after
from vitalweave.operators import cohort as C
from vitalweave.operators.cohort import Clause, CohortQuery
from vitalweave.operators.cohort_index import evaluate_cohort_table
from vitalweave.operators.features import online_features
from vitalweave.plans.registry import Tables, clock, plan, rounded
from vitalweave.session import shared_dir
from vitalweave.sources.tables import export_cohort, export_rows

GLUCOSE = (Clause("resource_type", "=", "observation"), Clause("concept", "=", "'Blood-Glucose'"), Clause("value", ">=", "100"))
GLUCOSE_SQL = "resource_type = 'Observation' AND concept = 'blood-glucose' AND value >= 100"
VITALS = (
    Clause("concept", "in", "(heart-rate, 'blood-pressure')"),
    Clause("value", "<", 200),
    Clause("timestamp", ">=", "2024-01-05 06:30"),
    Clause("timestamp", "<=", "2024-01-28T00:00:00+01:00"),
    Clause("unit", "!=", "mg/dL"),
)
VITALS_SQL = (
    "concept IN ('heart-rate', 'blood-pressure') AND value < 200 AND timestamp >= TIMESTAMP '2024-01-05 06:30:00' "
    "AND timestamp <= TIMESTAMP '2024-01-27 23:00:00' AND unit <> 'mg/dL'"
)
AS_OF = "2024-01-30 12:00:00"


@plan(
    "c1_cohort_filter",
    f"SELECT id, patient_id, concept, value, timestamp FROM facts WHERE tenant_id = 'tenant-1' AND {VITALS_SQL}",
    "facts",
)
def _(t: Tables):
    rows = C.cohort_filter(t["facts"], VITALS, tenant="tenant-1")
    return rows.select("id", "patient_id", "concept", "value", "timestamp")


@plan(
    "c1_lenient_filter",
    "SELECT id FROM facts WHERE master_id = 'master-7' OR FALSE",
    "facts",
)
def _(t: Tables):
    clauses = [Clause("master_id", "=", "master-7"), Clause("value", ">", "high"), Clause("ward", "=", "3")]
    return C.cohort_filter(t["facts"], clauses, strict=False).select("id")


@plan(
    "c2_cohort_project",
    f"SELECT patient_id, concept, code_loinc, value, CAST(NULL AS VARCHAR) AS ward FROM facts WHERE {GLUCOSE_SQL}",
    "facts",
)
def _(t: Tables):
    rows = C.cohort_filter(t["facts"], GLUCOSE)
    return C.cohort_project(rows, ["patient_id", "concept", "code_loinc", "value", "ward"])


@plan("c3_cohort_count", f"SELECT count(DISTINCT patient_id) AS patient_count FROM facts WHERE {GLUCOSE_SQL}", "facts")
def _(t: Tables):
    return C.cohort_count(C.cohort_filter(t["facts"], GLUCOSE))


@plan(
    "c4_cohort_patients",
    f"SELECT DISTINCT patient_id FROM facts WHERE {GLUCOSE_SQL} ORDER BY patient_id LIMIT 500",
    "facts",
)
def _(t: Tables):
    return C.cohort_patients(C.cohort_filter(t["facts"], GLUCOSE))


@plan(
    "c5_cohort_records",
    f"""SELECT patient_id, resource_type, concept, value, timestamp FROM facts WHERE {GLUCOSE_SQL}
        ORDER BY timestamp DESC, id DESC LIMIT 200""",
    "facts",
)
def _(t: Tables):
    return C.cohort_records(C.cohort_filter(t["facts"], GLUCOSE))


@plan(
    "c6_cohort_query",
    f"""WITH kept AS (SELECT * FROM facts WHERE tenant_id = 'tenant-2' AND {GLUCOSE_SQL})
        SELECT 'count' AS part, CAST(count(DISTINCT patient_id) AS VARCHAR) AS item FROM kept
        UNION ALL (SELECT DISTINCT 'patient', patient_id FROM kept ORDER BY 2 LIMIT 500)
        UNION ALL (SELECT 'record', concat(patient_id, ' ', CAST(value AS VARCHAR)) FROM kept ORDER BY timestamp DESC, id DESC LIMIT 200)
        UNION ALL (SELECT 'slice', concat(master_id, ':', resource_type, ':', CAST(id AS VARCHAR)) FROM facts
                   WHERE tenant_id = 'tenant-2' AND lower(resource_type) = 'observation'
                   ORDER BY timestamp DESC, concat(master_id, ':', resource_type, ':', CAST(id AS VARCHAR)) DESC LIMIT 200)""",
    "facts",
)
def _(t: Tables):
    parts = C.cohort_query(t["facts"], CohortQuery(GLUCOSE, tenant="tenant-2", metric="observation"))

    def items(part: str, df: DataFrame, item):
        return df.select(F.lit(part).alias("part"), item.alias("item"))

    return (
        items("count", parts["count"], F.col("patient_count").cast("string"))
        .unionByName(items("patient", parts["patients"], F.col("patient_id")))
        .unionByName(items("record", parts["records"], F.concat_ws(" ", "patient_id", F.col("value").cast("string"))))
        .unionByName(items("slice", parts["slices"], F.col("id")))
    )


@plan(
    "c7_slice_rollups",
    """SELECT master_id, patient_id, lower(resource_type) AS metric, concept, value, timestamp AS event_time
       FROM facts WHERE lower(resource_type) = 'condition'
       ORDER BY timestamp DESC, concat(master_id, ':', resource_type, ':', CAST(id AS VARCHAR)) DESC LIMIT 200""",
    "facts",
)
def _(t: Tables):
    rows = C.slice_rollups(C.rollup_rows(t["facts"]), metric="condition")
    return rows.select("master_id", "patient_id", "metric", "concept", "value", "event_time")


@plan("c8_tenant_view", "SELECT id, tenant_id FROM facts WHERE tenant_id = 'tenant-3'", "facts")
def _(t: Tables):
    return C.tenant_view(t["facts"], "tenant-3").select("id", "tenant_id")


@plan(
    "c9_tenant_of",
    """SELECT id, CASE id % 3 WHEN 0 THEN tenant_id WHEN 1 THEN concat('c-', tenant_id) ELSE 'public' END AS tenant FROM facts""",
    "facts",
)
def _(t: Tables):
    kind, named = F.col("id") % 3, F.col("tenant_id")
    canonical = F.create_map(F.lit("tenant_id"), F.when(kind == 0, named).otherwise(F.lit(" ")))
    codes = F.create_map(F.lit("tenant_id"), F.when(kind != 2, F.concat(F.lit("c-"), named)))
    maps = t["facts"].select("id", canonical.alias("canonical"), codes.alias("codes"))
    return maps.select("id", C.tenant_of(F.col("canonical"), F.col("codes")).alias("tenant"))


TIMELINE_SQL = """SELECT id, patient_id, concept, timestamp FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, id) AS n FROM facts {0}) x WHERE n <= {1}"""


@plan("c10_timeline", TIMELINE_SQL.format("", 20), "facts")
def _(t: Tables):
    return C.timeline(t["facts"], n=20).select("id", "patient_id", "concept", "timestamp")


@plan(
    "c10_timeline_listed",
    TIMELINE_SQL.format(f"WHERE patient_id IN (SELECT patient_id FROM facts WHERE {GLUCOSE_SQL})", 500),
    "facts",
)
def _(t: Tables):
    listed = C.cohort_filter(t["facts"], GLUCOSE).select("patient_id")
    return C.timeline(t["facts"], listed).select("id", "patient_id", "concept", "timestamp")


def feature_rows(t: Tables) -> DataFrame:
    """Stored features as maps."""
    values = F.create_map(F.lit("concept"), F.col("concept"), F.lit("value"), F.col("value").cast("string"))
    rows = t["offline_features"]
    return rows.select("entity_id", "version", values.alias("features"), "created_at", "source_id")


def drilldown_sql(where: str) -> str:
    return f"""WITH events_of AS (SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, id) AS n FROM facts {where}) x WHERE n <= 10),
        stored AS (SELECT entity_id, max_by(concept, row(created_at, version)) AS concept FROM offline_features GROUP BY entity_id),
        live AS (SELECT entity_id, max_by(concept, row(created_at, version)) AS concept FROM offline_features
                 WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY entity_id),
        linked AS (SELECT patient_id, max_by(master_id, row(created_at, id)) AS master_patient_id,
                          max_by(method, row(created_at, id)) AS link_method, count(*) AS link_count
                   FROM fact_links GROUP BY patient_id)
        SELECT e.id, e.patient_id, e.concept, coalesce(l.concept, s.concept) AS feature_concept,
               CASE WHEN l.entity_id IS NOT NULL THEN 'online' ELSE 'offline' END AS feature_source,
               k.master_patient_id, k.link_method, CAST(coalesce(k.link_count, 0) AS BIGINT) AS link_count
        FROM events_of e LEFT JOIN stored s ON s.entity_id = e.patient_id LEFT JOIN live l ON l.entity_id = e.patient_id
        LEFT JOIN linked k ON k.patient_id = e.patient_id"""


def drilldown(t: Tables, patients: DataFrame | None) -> DataFrame:
    stored = feature_rows(t)
    live = online_features(stored, clock(AS_OF), timedelta(days=1))
    rows = C.drilldown(t["facts"], live, stored, t["fact_links"], patients, n=10)
    return rows.select(
        "id",
        "patient_id",
        "concept",
        F.col("features")["concept"].alias("feature_concept"),
        "feature_source",
        "master_patient_id",
        "link_method",
        F.coalesce("link_count", F.lit(0)).cast("bigint").alias("link_count"),
    )


DRILLDOWN_TABLES = ("facts", "offline_features", "fact_links")


@plan("c11_drilldown", drilldown_sql(""), *DRILLDOWN_TABLES)
def _(t: Tables):
    return drilldown(t, None)


@plan(
    "c11_drilldown_listed",
    drilldown_sql(f"WHERE patient_id IN (SELECT patient_id FROM facts WHERE {GLUCOSE_SQL})"),
    *DRILLDOWN_TABLES,
)
def _(t: Tables):
    return drilldown(t, C.cohort_filter(t["facts"], GLUCOSE).select("patient_id"))


NUMERIC = r"regexp_matches(trim(value), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


@plan(
    "c12_materialize_cohort",
    f"""SELECT 'glucose-high' AS cohort_id, patient_id, count(*) AS record_count,
       max_by(concept, row(timestamp, id)) AS latest_concept, max_by(value, row(timestamp, id)) AS latest_value,
       max(timestamp) AS latest_timestamp, round(avg(value), 6) AS average_value
       FROM facts WHERE {GLUCOSE_SQL} GROUP BY patient_id""",
    "facts",
)
def flagship(t: Tables):
    rows = C.materialize_cohort(t["facts"], CohortQuery(GLUCOSE), "glucose-high")
    return rows.withColumn("average_value", rounded("average_value"))


@plan(
    "c12_materialize_mixed",
    f"""SELECT 'all' AS cohort_id, patient_id, count(*) AS record_count,
       arg_max_null(concept, row(timestamp, id)) AS latest_concept, arg_max_null(value, row(timestamp, id)) AS latest_value,
       max(timestamp) AS latest_timestamp,
       round(avg(CASE WHEN {NUMERIC} THEN CAST(trim(value) AS DOUBLE) END), 6) AS average_value
       FROM mixed_facts GROUP BY patient_id""",
    "mixed_facts",
)
def _(t: Tables):
    rows = C.materialize_cohort(t["mixed_facts"], CohortQuery(), "all")
    return rows.withColumn("average_value", rounded("average_value"))


SAVED = {
    "glucose-high": GLUCOSE,
    "vitals": VITALS,
    "diabetes": (Clause("code_snomed", "=", "44054006"),),
    "fast-heart": (Clause("concept", "=", "heart-rate"), Clause("value", ">", 100)),
    "master-range": (Clause("master_id", ">=", "master-5"), Clause("resource_type", "!=", "Procedure")),
}
SAVED_SQL = {
    "glucose-high": GLUCOSE_SQL,
    "vitals": VITALS_SQL,
    "diabetes": "code_snomed = '44054006'",
    "fast-heart": "concept = 'heart-rate' AND value > 100",
    "master-range": "master_id >= 'master-5' AND resource_type <> 'Procedure'",
}


@plan(
    "c13_evaluate_cohorts",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS cohort_id, patient_id FROM facts WHERE {where}" for name, where in SAVED_SQL.items()
    ),
    "facts",
)
def _(t: Tables):
    return C.evaluate_cohorts(t["facts"], SAVED)


@plan(
    "c13_clause_table",
    """WITH n AS (SELECT cohort_id, count(*) AS clauses FROM cohort_clauses GROUP BY cohort_id),
       c AS (SELECT *, [lower(trim(v)) FOR v IN string_split(trim(value, '()'), ',')] AS vals, TRY_CAST(value AS DOUBLE) AS num,
               CASE WHEN field = 'timestamp' THEN TRY_CAST(value AS TIMESTAMP) END AS since FROM cohort_clauses),
       hit AS (SELECT f.id, f.patient_id, c.cohort_id, count(*) AS held FROM facts f JOIN c ON CASE field
           WHEN 'concept' THEN CASE op WHEN '!=' THEN f.concept <> vals[1] WHEN '>=' THEN f.concept >= vals[1] ELSE list_contains(vals, f.concept) END
           WHEN 'value' THEN CASE op WHEN '>=' THEN f.value >= num WHEN '>' THEN f.value > num WHEN '<' THEN f.value < num ELSE f.value <= num END
           ELSE f.timestamp >= since END GROUP BY ALL)
       SELECT DISTINCT cohort_id, patient_id FROM hit JOIN n USING (cohort_id) WHERE held = clauses""",
    "facts",
    "cohort_clauses",
)
def _(t: Tables):
    return evaluate_cohort_table(t["facts"], t["cohort_clauses"])


@plan(
    "c14_visible_templates",
    """SELECT id, cohort_id, tenant_id, created_at FROM tenant_jobs WHERE tenant_id IS NULL OR tenant_id = 'tenant-2'
       ORDER BY created_at DESC, id DESC LIMIT 25""",
    "tenant_jobs",
)
def _(t: Tables):
    return C.visible_templates(t["tenant_jobs"], "tenant-2").select("id", "cohort_id", "tenant_id", "created_at")


@plan(
    "c15_visible_materializations",
    """SELECT id, cohort_id, tenant_id, status, created_at FROM tenant_jobs WHERE tenant_id IS NULL OR tenant_id = 'tenant-1'
       ORDER BY created_at DESC, id DESC LIMIT 50""",
    "tenant_jobs",
)
def _(t: Tables):
    rows = C.visible_materializations(t["tenant_jobs"], "tenant-1")
    return rows.select("id", "cohort_id", "tenant_id", "status", "created_at")


@plan(
    "c15_materialization_counts",
    """SELECT status, count(*) AS jobs FROM tenant_jobs WHERE tenant_id IS NULL OR tenant_id = 'tenant-1' GROUP BY status""",
    "tenant_jobs",
)
def _(t: Tables):
    return C.materialization_counts(t["tenant_jobs"], "tenant-1")


@plan(
    "c16_page",
    "SELECT id, patient_id, timestamp FROM facts ORDER BY timestamp DESC, id LIMIT 50 OFFSET 100",
    "facts",
)
def _(t: Tables):
    rows = t["facts"].select("id", "patient_id", "timestamp")
    return C.page(rows, [F.desc("timestamp"), F.asc("id")], 50, 3)


def paged(t: Tables) -> DataFrame:
    return t["facts"].select("id", "patient_id", "timestamp")


@plan(
    "c16_page_jump",
    "SELECT id, patient_id, timestamp FROM facts ORDER BY timestamp DESC, id LIMIT 120 OFFSET 600",
    "facts",
)
def _(t: Tables):
    table = PagedTable.build(paged(t), f"{shared_dir(t.spark)}/pages-{uuid.uuid4().hex}", ["timestamp", "id"], [True, False], 2_000)
    return table.page(120, 6)


@plan(
    "c16_page_after",
    """SELECT id, patient_id, timestamp FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id) AS n FROM facts) x
       WHERE n > (SELECT count(*) FROM facts WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00') ORDER BY n LIMIT 75""",
    "facts",
)
def _(t: Tables):
    return page_after(paged(t), ["timestamp", "id"], 75, ["2024-01-15 00:00:00", 2**62], [True, False])


@plan(
    "s6_exported_file",
    f"""SELECT patient_id, resource_type, concept, coalesce(printf('%.6f', value), '') AS value,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM facts WHERE {VITALS_SQL}""",
    "facts",
)
def _(t: Tables):
    folder = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    export_cohort(C.cohort_filter(t["facts"], VITALS), C.DEFAULT_FIELDS, folder)
    read = t.spark.read.option("header", True).csv(folder)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.DEFAULT_FIELDS])


@plan(
    "s5_rollup_rows",
    """SELECT concat(master_id, ':', resource_type, ':', CAST(id AS VARCHAR)) AS id, master_id, patient_id,
       lower(resource_type) AS metric, concept, value, unit, timestamp AS event_time FROM facts""",
    "facts",
)
def _(t: Tables):
    return C.rollup_rows(t["facts"])


@plan(
    "s6_export_cohort",
    f"""SELECT patient_id, resource_type, concept, coalesce(printf('%.6f', value), '') AS value,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM facts WHERE {VITALS_SQL}""",
    "facts",
)
def _(t: Tables):
    return export_rows(C.cohort_filter(t["facts"], VITALS), C.DEFAULT_FIELDS)
