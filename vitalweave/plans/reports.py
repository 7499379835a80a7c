"""Operational reports, clinical studies and the clean room."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vitalweave.operators import cleanroom as D
from vitalweave.operators import reports as M
from vitalweave.operators import studies as E
from vitalweave.operators.privacy import vault_rows
from vitalweave.plans.registry import Tables, clock, plan, rounded

NOW = "2001-08-01 00:02:00"
DAY = timedelta(days=1)
JOBS_NOW = "2024-01-30 12:00:00"


def overview(t: Tables):
    return M.overview(t["requests"], t["jobs"], t["facts"], clock(NOW), timedelta(days=30), DAY)


OVERVIEW_SQL = f"""SELECT
    (SELECT avg(epoch(updated_at - created_at) * 1000) FROM requests
     WHERE status = 'published' AND updated_at > TIMESTAMP '{NOW}' - INTERVAL '30' DAY AND updated_at <= TIMESTAMP '{NOW}') AS publish_latency_ms,
    (SELECT count(*) FROM requests WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL '1' DAY AND created_at <= TIMESTAMP '{NOW}') AS requests_recent,
    (SELECT count(*) FROM requests WHERE status <> 'published') AS backlog,
    (SELECT count(*) FROM requests WHERE status = 'failed' AND CAST(updated_at AS DATE) = DATE '2001-08-01') AS failed_today,
    (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) AS jobs_active,
    (SELECT count(*) FROM facts WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL '1' DAY AND timestamp <= TIMESTAMP '{NOW}') AS facts_recent"""
OVERVIEW_TABLES = ("requests", "jobs", "facts")


@plan("m1_overview", OVERVIEW_SQL, *OVERVIEW_TABLES)
def _(t: Tables):
    return overview(t)


@plan(
    "m2_stage_health",
    f"""WITH o AS ({OVERVIEW_SQL})
        SELECT 'ingestion' AS stage, CASE WHEN backlog < 5 AND requests_recent > 0 THEN 'healthy'
               WHEN backlog < 5 OR requests_recent > 0 THEN 'degraded' ELSE 'failing' END AS status,
               concat(requests_recent, ' requests, backlog ', backlog) AS details FROM o
        UNION ALL SELECT 'privacy', CASE WHEN failed_today < 25 THEN 'healthy' ELSE 'degraded' END, concat(failed_today, ' failures today') FROM o
        UNION ALL SELECT 'normalization', CASE WHEN facts_recent > 0 THEN 'healthy' ELSE 'degraded' END,
               concat(facts_recent, ' facts, ', jobs_active, ' jobs active') FROM o""",
    *OVERVIEW_TABLES,
)
def _(t: Tables):
    return M.stage_health(overview(t))


@plan(
    "m3_request_summary",
    f"""WITH x AS (SELECT *, created_at > TIMESTAMP '{NOW}' - INTERVAL '7' DAY AND created_at <= TIMESTAMP '{NOW}' AS fresh FROM requests)
        SELECT count(*) FILTER (fresh AND status = 'accepted') AS accepted, count(*) FILTER (fresh AND status = 'published') AS published,
               count(*) FILTER (fresh AND status = 'failed') AS failed, count(*) FILTER (fresh AND status = 'failed') AS dead_letters,
               count(*) FILTER (status <> 'published') AS backlog,
               count(*) FILTER (created_at > TIMESTAMP '{NOW}' - INTERVAL '1' DAY AND created_at <= TIMESTAMP '{NOW}') AS throughput FROM x""",
    "requests",
)
def _(t: Tables):
    return M.request_summary(t["requests"], clock(NOW), timedelta(days=7), DAY)


COLUMNS_SQL = "id, source, format, status, retry_count, created_at, updated_at"


@plan(
    "m4_recent_requests",
    f"""SELECT {COLUMNS_SQL}, CASE WHEN trim(error) <> '' THEN error END AS error FROM requests ORDER BY created_at DESC, id DESC LIMIT 25""",
    "requests",
)
def _(t: Tables):
    return M.recent_requests(t["requests"])


@plan(
    "m5_privacy_stats",
    """SELECT count(*) FILTER (status = 'failed' AND CAST(created_at AS DATE) = DATE '2000-03-01') AS failed_today,
       count(*) FILTER (status = 'accepted' AND CAST(created_at AS DATE) = DATE '2000-03-01') AS accepted_today,
       (SELECT count(DISTINCT note) FROM phi_notes WHERE record_id % 2 = 0 OR record_id % 3 = 0 OR record_id % 5 = 0
               OR record_id % 7 = 0 OR record_id % 11 = 0) AS vault_size,
       round(coalesce(count(*) FILTER (status = 'failed' AND CAST(created_at AS DATE) = DATE '2000-03-01')
             / nullif(count(*) FILTER (status IN ('failed', 'accepted') AND CAST(created_at AS DATE) = DATE '2000-03-01'), 0), 0), 8)::DOUBLE AS failure_rate
       FROM requests""",
    "requests",
    "phi_notes",
)
def _(t: Tables):
    vault = vault_rows(t["phi_notes"].select("note"), ["note"], "pepper")
    stats = M.privacy_stats(t["requests"], vault, clock("2000-03-01 00:02:00"))
    return stats.withColumn("failure_rate", rounded("failure_rate", 8))


@plan(
    "m5_top_reasons",
    """SELECT coalesce(nullif(trim(error), ''), 'Unknown reason') AS reason, count(*) AS failures FROM requests WHERE status = 'failed'
       GROUP BY 1 ORDER BY failures DESC, reason LIMIT 5""",
    "requests",
)
def _(t: Tables):
    return M.top_reasons(t["requests"])


@plan(
    "m6_recent_incidents",
    f"""SELECT {COLUMNS_SQL}, trim(coalesce(error, '')) AS error FROM requests WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 20""",
    "requests",
)
def _(t: Tables):
    return M.recent_incidents(t["requests"])


@plan(
    "m7_latency_by_minute",
    f"""SELECT date_trunc('minute', created_at) AS minute, round(avg(latency_ms), 6) AS latency_ms FROM prediction_logs
        WHERE created_at > TIMESTAMP '{JOBS_NOW}' - INTERVAL '48' HOUR AND created_at <= TIMESTAMP '{JOBS_NOW}' GROUP BY 1""",
    "prediction_logs",
)
def _(t: Tables):
    rows = M.latency_by_minute(t["prediction_logs"], clock(JOBS_NOW), timedelta(hours=48))
    return rows.select("minute", rounded("latency_ms"))


@plan(
    "m8_prediction_summary",
    """WITH x AS (SELECT * FROM prediction_logs)
       SELECT count(*) AS total, CAST(floor(epoch(max(created_at) - min(created_at))) AS BIGINT) AS window_seconds,
              round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms,
              round(avg(latency_ms), 6) AS average_latency_ms, round(avg(confidence), 6) AS average_confidence FROM x""",
    "prediction_logs",
)
def _(t: Tables):
    figures = M.prediction_summary(t["prediction_logs"])
    names = ["p50_latency_ms", "p95_latency_ms", "average_latency_ms", "average_confidence"]
    return figures.select("total", "window_seconds", *[rounded(n) for n in names])


@plan(
    "m8_prediction_events",
    "SELECT id, patient_id, model_name, latency_ms, confidence, created_at FROM prediction_logs ORDER BY created_at DESC, id DESC LIMIT 25",
    "prediction_logs",
)
def _(t: Tables):
    return M.prediction_events(t["prediction_logs"])


@plan(
    "m9_alert_counts",
    f"""SELECT count(*) FILTER (status = 'failed') AS critical, count(*) FILTER (status = 'accepted') AS warning,
        count(*) FILTER (status = 'published') AS info FROM requests
        WHERE updated_at > TIMESTAMP '{NOW}' - INTERVAL '7' DAY AND updated_at <= TIMESTAMP '{NOW}'""",
    "requests",
)
def _(t: Tables):
    return M.alert_counts(t["requests"], clock(NOW))


@plan(
    "m9_alert_items",
    """SELECT id, source, format, status, coalesce(error, '') AS error,
       CASE WHEN json_valid(payload) THEN payload ELSE concat('{"raw":"', payload, '"}') END AS payload,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
       FROM requests WHERE status IN ('failed', 'accepted') ORDER BY requests.updated_at DESC, id DESC LIMIT 25""",
    "requests",
)
def _(t: Tables):
    return M.alert_items(t["requests"])


SUMMARY_SQL = """SELECT s.study_id, s.code, s.status,
    (SELECT count(*) FROM sites c WHERE c.study_id = s.study_id) AS site_count,
    (SELECT count(*) FROM form_submissions c WHERE c.study_id = s.study_id) AS form_count,
    (SELECT count(DISTINCT slug) FROM form_submissions c WHERE c.study_id = s.study_id) AS form_slugs,
    (SELECT count(*) FROM visits c WHERE c.study_id = s.study_id) AS visit_count,
    (SELECT count(*) FROM visits c WHERE c.study_id = s.study_id AND required) AS required_visits,
    (SELECT count(*) FROM subjects c WHERE c.study_id = s.study_id AND c.status IN ('enrolled', 'active', 'randomized')) AS active_subjects,
    (SELECT count(*) FROM subjects c WHERE c.study_id = s.study_id) AS total_subjects FROM studies s"""
SUMMARY_TABLES = ("studies", "sites", "form_submissions", "visits", "subjects")


def summary(t: Tables):
    return E.study_summary(*[t[name] for name in SUMMARY_TABLES])


@plan("e1_study_summary", SUMMARY_SQL, *SUMMARY_TABLES)
def _(t: Tables):
    return summary(t)


@plan(
    "e1_study_forms",
    """SELECT study_id, slug, form_id, row_number() OVER (PARTITION BY study_id, slug ORDER BY submitted_seq) AS version FROM form_submissions""",
    "form_submissions",
)
def _(t: Tables):
    forms = E.assign_form_versions(t["form_submissions"])
    return E.study_forms(forms).select("study_id", "slug", "form_id", "version")


@plan("e1_study_visits", "SELECT study_id, visit_order, visit_id, name FROM visits", "visits")
def _(t: Tables):
    return E.study_visits(t["visits"]).select("study_id", "visit_order", "visit_id", "name")


@plan(
    "e2_recent_studies",
    "SELECT study_id, code, created_at FROM study_dates ORDER BY created_at DESC, study_id DESC LIMIT 10",
    "study_dates",
)
def _(t: Tables):
    return E.recent_studies(t["study_dates"], 10).select("study_id", "code", "created_at")


@plan(
    "e3_assign_form_versions",
    """WITH existing AS (SELECT n_nationkey AS study_id, 'economy' AS slug, n_regionkey + 3 AS version FROM nation),
       numbered AS (SELECT *, row_number() OVER (PARTITION BY study_id, slug ORDER BY submitted_seq) AS n FROM form_submissions)
       SELECT x.form_id, x.study_id, x.slug, n + coalesce(e.version, 0) AS version, 'draft' AS status
       FROM numbered x LEFT JOIN existing e ON e.study_id = x.study_id AND e.slug = x.slug""",
    "form_submissions",
)
def _(t: Tables):
    existing = t["nation"].select(
        F.col("n_nationkey").alias("study_id"), F.lit("economy").alias("slug"), (F.col("n_regionkey") + 3).alias("version")
    )
    bucket = F.floor(F.col("submitted_seq") / 500)
    rows = E.assign_form_versions(t["form_submissions"], existing, bucket)
    return rows.select("form_id", "study_id", "slug", "version", "status")


@plan(
    "e4_apply_consents",
    """WITH last AS (SELECT subject_id, max_by(signed_at, row(recorded_at, signature_id)) AS signed_at FROM signatures GROUP BY subject_id)
       SELECT s.subject_id, CASE WHEN l.subject_id IS NOT NULL THEN 'enrolled' ELSE s.status END AS status,
              coalesce(l.signed_at, CASE WHEN s.subject_id % 3 = 0 THEN TIMESTAMP '2020-01-01' END) AS consented_at
       FROM subjects s LEFT JOIN last l ON l.subject_id = s.subject_id""",
    "subjects",
    "signatures",
)
def _(t: Tables):
    earlier = F.when(F.col("subject_id") % 3 == 0, clock("2020-01-01"))
    subjects = t["subjects"].withColumn("consented_at", earlier)
    return E.apply_consents(subjects, t["signatures"]).select("subject_id", "status", "consented_at")


def per_study_sql(columns: str, table: str, order: str, n: int) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY {order}) AS n FROM {table}) x WHERE n <= {n}"""


@plan(
    "e5_consent_versions",
    per_study_sql("id, study_id, version, effective_at", "consent_versions", "effective_at DESC, id DESC", 50),
    "consent_versions",
)
def _(t: Tables):
    return E.list_consent_versions(t["consent_versions"])


@plan(
    "e5_list_subjects",
    per_study_sql("subject_id, study_id, subject_code, created_at", "subject_dates", "created_at DESC, subject_id DESC", 250),
    "subject_dates",
)
def _(t: Tables):
    return E.list_subjects(t["subject_dates"], 250)


AUDIT_SQL = """SELECT id, study_id, CASE WHEN actor = '' THEN 'system' ELSE actor END AS actor, action, created_at
    FROM audit_events WHERE study_id IS NOT NULL"""


@plan("e6_audit_rows", AUDIT_SQL, "audit_events")
def _(t: Tables):
    return E.audit_rows(t["audit_events"])


@plan(
    "e6_audit_tail",
    per_study_sql("id, study_id, actor, action, created_at", f"({AUDIT_SQL}) a", "created_at DESC, id DESC", 50),
    "audit_events",
)
def _(t: Tables):
    return E.audit_tail(E.audit_rows(t["audit_events"]))


@plan(
    "e7_current_study_status",
    'SELECT study_id, max_by(status, row("at", seq)) AS status, max("at") AS "at" FROM study_changes GROUP BY study_id',
    "study_changes",
)
def _(t: Tables):
    return E.current_study_status(t["study_changes"]).select("study_id", "status", "at")


@plan(
    "e8_with_defaults",
    """SELECT 'visit' AS kind, visit_id AS id, CAST(coalesce(required, TRUE) AS VARCHAR) AS value FROM visits
       UNION ALL SELECT 'subject', subject_id, 'screening' FROM subjects
       UNION ALL SELECT 'site', site_id, 'planned' FROM sites""",
    "visits",
    "subjects",
    "sites",
)
def _(t: Tables):
    visits = E.with_defaults(t["visits"], "visit_templates")
    subjects = E.with_defaults(t["subjects"].drop("status"), "subjects")
    sites = E.with_defaults(t["sites"].withColumn("status", F.lit("")), "study_sites")

    def rows(df, kind: str, id: str, value: str):
        return df.select(F.lit(kind).alias("kind"), F.col(id).cast("bigint").alias("id"), F.col(value).cast("string").alias("value"))

    return (
        rows(visits, "visit", "visit_id", "required")
        .unionByName(rows(subjects, "subject", "subject_id", "status"))
        .unionByName(rows(sites, "site", "site_id", "status"))
    )


@plan(
    "e9_portfolio",
    f"""WITH x AS ({SUMMARY_SQL}) SELECT count(*) AS studies, count(*) FILTER (status IN ('active', 'enrolling')) AS active_studies,
        CAST(sum(total_subjects) AS BIGINT) AS total_subjects, CAST(sum(active_subjects) AS BIGINT) AS active_subjects FROM x""",
    *SUMMARY_TABLES,
)
def _(t: Tables):
    return E.portfolio(summary(t))


@plan(
    "e10_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Tables):
    return E.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@plan(
    "e10_orphans",
    """SELECT id, study_id FROM consent_versions WHERE study_id NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
    "consent_versions",
)
def _(t: Tables):
    parents = t["supplier"].filter("s_acctbal > 5000")
    return E.orphans(t["consent_versions"], parents, "study_id", "s_nationkey").select("id", "study_id")


BOUNDS = D.Bounds(0.0, 200.0, 100_000)


@plan(
    "d1_exact_aggregate",
    """WITH k AS (SELECT DISTINCT concept FROM catalog UNION SELECT 'temperature'),
       x AS (SELECT concept, least(greatest(value, 0), 200) AS v FROM facts WHERE value IS NOT NULL)
       SELECT k.concept, count(v) AS n, round(coalesce(sum(v), 0), 4) AS total, round(avg(v), 6) AS mean
       FROM k LEFT JOIN x ON x.concept = k.concept GROUP BY k.concept""",
    "facts",
    "catalog",
)
def _(t: Tables):
    listed = t["catalog"].select("concept").unionByName(t["catalog"].select(F.lit("temperature").alias("concept")).limit(1))
    rows = D.exact_aggregate(t["facts"], ["concept"], "patient_id", "value", BOUNDS, "id", listed)
    return rows.select("concept", "n", rounded("total", 4), rounded("mean"))


@plan(
    "d1_bounded_aggregate",
    """WITH k AS (SELECT DISTINCT concept FROM catalog),
       r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp DESC, id) AS n FROM facts
             WHERE value IS NOT NULL AND concept IN (SELECT concept FROM k)),
       x AS (SELECT concept, least(greatest(value, 5), 60) AS v FROM r WHERE n <= 3)
       SELECT k.concept, count(v) AS n, round(coalesce(sum(v), 0), 4) AS total, round(avg(v), 6) AS mean
       FROM k LEFT JOIN x ON x.concept = k.concept GROUP BY k.concept""",
    "facts",
    "catalog",
)
def _(t: Tables):
    bounds, newest = D.Bounds(5.0, 60.0, 3), [F.desc("timestamp"), F.asc("id")]
    rows = D.exact_aggregate(t["facts"], ["concept"], "patient_id", "value", bounds, "id", t["catalog"].select("concept"), newest)
    return rows.select("concept", "n", rounded("total", 4), rounded("mean"))


@plan("d1_dp_aggregate")
def _(t: Tables):
    bounds = D.Bounds(0.0, 400.0, 20)
    return D.dp_aggregate(
        t["facts"], ["concept"], "patient_id", "value", bounds, "id", t["catalog"].select("concept"), 1.0, seed=7
    )


@plan(
    "d2_budget_ledger",
    """WITH x AS (SELECT *, round(sum(epsilon) OVER (PARTITION BY owner ORDER BY asked_at, query_id), 6) AS used FROM room_log)
       SELECT query_id, owner, used, used <= 150 AS accepted FROM x""",
    "room_log",
)
def _(t: Tables):
    return D.budget_ledger(t["room_log"], 150.0).select("query_id", "owner", rounded("used"), "accepted")


@plan(
    "d2_budget_admission",
    """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY asked_at, query_id) AS n, CAST(round(epsilon * 1000000) AS BIGINT) AS u FROM asks),
       f AS (SELECT owner, n, query_id, u <= 12000000 AS accepted, CASE WHEN u <= 12000000 THEN u ELSE 0 END AS used FROM o WHERE n = 1
             UNION ALL SELECT o.owner, o.n, o.query_id, f.used + o.u <= 12000000, f.used + CASE WHEN f.used + o.u <= 12000000 THEN o.u ELSE 0 END
             FROM f JOIN o ON o.owner = f.owner AND o.n = f.n + 1)
       SELECT query_id, owner, accepted, round(used / 1000000, 6) AS used FROM f""",
    "asks",
)
def _(t: Tables):
    return D.admit_queries(t["asks"], 12.0).select("query_id", "owner", "accepted", rounded("used"))


@plan(
    "d3_lineage",
    """SELECT query_id, CAST(unnest(range(len(string_split(source_list, ',')))) AS INTEGER) AS position,
       unnest(string_split(source_list, ',')) AS source FROM room_log""",
    "room_log",
)
def _(t: Tables):
    log = t["room_log"].select("query_id", F.split("source_list", ",").alias("sources"))
    return D.lineage(log)
