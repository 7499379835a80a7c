"""Sources, sinks and streams: each plan writes to the shared folder and reads the stored rows back."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key
from vitalweave.operators.cohort import Clause, CohortQuery, cohort_features, cohort_filter, cohort_patients, drilldown, materialize_cohort
from vitalweave.operators.match_index import MatchIndex
from vitalweave.plans.clinical import CONDITION_SQL, KIND_SQL, OBSERVATION_SQL, PATIENT_SQL, TIME_SQL, VALUE_SQL
from vitalweave.plans.registry import Tables, clock, plan
from vitalweave.session import shared_dir
from vitalweave.sources import fixtures
from vitalweave.sources.events import decode_events, encode_events, split_quarantine, write_events
from vitalweave.sources.fact_table import FactTable
from vitalweave.sources.reference_data import CLINICAL_CONCEPTS, catalog_df
from vitalweave.sources.tables import append_facts, read_facts
from vitalweave.streaming import flow
from vitalweave.streaming.feature_store import KeyedFeatures
from vitalweave.streaming.online_features import read_online, run_online


def fresh_dir(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(t: Tables) -> DataFrame:
    """The events table as a file stream; the pattern fits a single file as well as a folder of part files."""
    schema = t["events"].schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")


def messages(df: DataFrame) -> DataFrame:
    """Event messages around the clinical payloads; every 23rd request comes from an unknown source."""
    request = F.struct(
        F.when(F.col("id") % 23 == 0, "pharmacy").otherwise("hospital").alias("source"),
        F.lit("fhir").alias("format"),
        F.col("payload_text").alias("data"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at"),
    )
    rows = df.select("id", F.col("received_at").alias("timestamp"), F.to_json(request).alias("request"))
    return encode_events(rows, F.col("request"), "upstream", "ingestion-service")


@plan("s1_decode_events", "SELECT CAST(event_id AS VARCHAR) AS id, 'upstream' AS type, event_id % 9 = 0 AS malformed FROM events")
def _(t: Tables):
    sent = messages(t["payloads"])
    damaged = F.when(F.col("key").cast("bigint") % 9 == 0, F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    read = decode_events(sent.select("key", damaged.alias("value")))
    good, bad = split_quarantine(read)
    lost = bad.select(F.regexp_extract("raw", r'"id":"(\d+)"', 1).alias("id"), F.lit("upstream").alias("type"), F.lit(True).alias("malformed"))
    return good.select("id", "type", F.lit(False).alias("malformed")).unionByName(lost)


@plan(
    "s2_write_events",
    """SELECT CAST(id AS VARCHAR) AS id, 'upstream' AS type, 'ingestion-service' AS source, CAST(2 AS BIGINT) AS headers,
       CASE WHEN id % 23 = 0 THEN 'pharmacy' ELSE 'hospital' END AS request_source FROM payloads""",
    "payloads",
)
def _(t: Tables):
    folder = fresh_dir(t, "messages")
    write_events(messages(t["payloads"]), folder)
    stored = t.spark.read.parquet(folder)
    event = F.from_json("value", "id string, type string, source string, data string")
    return stored.select(event.alias("e"), F.size("headers").cast("bigint").alias("headers")).select(
        "e.id", "e.type", "e.source", "headers", F.get_json_object("e.data", "$.source").alias("request_source")
    )


@plan("s4_append_facts", "SELECT id, patient_id, resource_type, concept, value, timestamp FROM facts WHERE resource_type = 'Observation'", "facts")
def _(t: Tables):
    folder = fresh_dir(t, "facts")
    append_facts(t["facts"], folder)
    stored = read_facts(t.spark, folder).filter("resource_type = 'Observation'")
    return stored.select("id", "patient_id", "resource_type", "concept", "value", "timestamp")


@plan("s9_read_table", "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(t: Tables):
    joined = t["region"].join(t["nation"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("r_regionkey", "r_name", "n_nationkey", "n_name")


def payload_stream(t: Tables) -> DataFrame:
    """The payload statement over the event stream."""
    return t.spark.sql(fixtures.STATEMENTS["payloads"], events=event_stream(t))


def run_clinical(t: Tables) -> str:
    out = fresh_dir(t, "flow")
    events = decode_events(messages(payload_stream(t)))
    catalog = catalog_df(t.spark, CLINICAL_CONCEPTS)
    flow.run_flow(events, f"{out}/tables", f"{out}/checkpoint", catalog, "pepper", t["links"]).awaitTermination()
    return f"{out}/tables"


KEPT_SQL = f"id % 23 <> 0 AND {KIND_SQL} IN ('observation', 'condition', 'procedure')"
CONCEPT_SQL = f"CASE {KIND_SQL} WHEN 'observation' THEN {OBSERVATION_SQL} ELSE {CONDITION_SQL} END"


@plan(
    "g1_clinical_flow",
    f"""WITH x AS (SELECT *, {CONCEPT_SQL} AS concept, {KIND_SQL} AS k, {PATIENT_SQL} AS patient FROM payloads WHERE {KEPT_SQL})
        SELECT CAST(id AS VARCHAR) AS id, concat('master-', substr(sha256(concat('patient_id:', patient)), 1, 16)) AS master_id,
               patient AS patient_id, concat(upper(substr(k, 1, 1)), substr(k, 2)) AS resource_type, x.concept,
               CASE WHEN k = 'observation' THEN {VALUE_SQL} END AS value, {TIME_SQL} AS timestamp,
               CASE WHEN k <> 'procedure' THEN nullif(c.snomed, '') END AS code_snomed
        FROM x LEFT JOIN catalog c ON c.concept = x.concept""",
    "payloads",
    "catalog",
)
def _(t: Tables):
    facts = flow.read_store(t.spark, run_clinical(t), "facts")
    return facts.select("id", "master_id", "patient_id", "resource_type", "concept", "value", "timestamp", "code_snomed")


@plan(
    "g2_stored_tables",
    f"""WITH kept AS (SELECT * FROM payloads WHERE {KEPT_SQL})
        SELECT 'facts' AS name, count(*) AS n FROM kept UNION ALL SELECT 'rollups', count(*) FROM kept
        UNION ALL SELECT 'features', count(DISTINCT row({PATIENT_SQL}, {TIME_SQL})) FROM kept UNION ALL SELECT 'links', count(*) FROM kept
        UNION ALL SELECT 'quarantine', (SELECT count(*) FROM payloads) - count(*) FROM kept""",
    "payloads",
)
def _(t: Tables):
    out = run_clinical(t)
    counts = None
    for name in ("facts", "rollups", "features", "links", "quarantine"):
        rows = flow.read_store(t.spark, out, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


@plan("g3_dedupe_events", "SELECT DISTINCT event_id // 3 AS id FROM events")
def _(t: Tables):
    out = fresh_dir(t, "dedupe")
    events = event_stream(t).select(F.expr("event_id div 3").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"))
    unique = flow.dedupe_events(events, "2 days").select("id")
    query = (
        unique.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    query.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


@plan(
    "g4_minute_rates",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type AS status, count(*) AS events FROM events GROUP BY ALL""",
)
def _(t: Tables):
    out = fresh_dir(t, "rates")
    events = event_stream(t).withColumn("timestamp", F.col("ts").cast("timestamp"))
    rates = flow.minute_rates(events, F.col("event_type"))
    flow.store_updates(rates, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    stored = t.spark.read.parquet(f"{out}/rows")
    newest = latest_per_key(stored, ["minute", "status"], ["batch_id"])
    return newest.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "status", "events")


def clinic_stream(t: Tables) -> DataFrame:
    """Messages of the clinic visits over the event stream."""
    visits = t.spark.sql(fixtures.STATEMENTS["clinic_visits"], events=event_stream(t), registry=t["registry"])
    return messages(t.spark.sql(fixtures.STATEMENTS["clinic_payloads"], clinic_visits=visits))


def clinic_options(t: Tables, out: str) -> dict:
    """Links by record number, else by similarity with the known patients of the tenant."""
    links = t["clinic_links"].withColumn("created_at", clock("2024-01-01 00:00:00"))
    MatchIndex.build(links, f"{out}/index", "tenant_id", "patient_id", "master_id")
    similar = flow.Similar(f"{out}/index")
    return {"links": links, "link_fields": ("mrn",), "similar": similar, "entity": "patient_id", "keyed_features": True}


def run_clinic(t: Tables) -> str:
    out = fresh_dir(t, "clinic")
    events, catalog = decode_events(clinic_stream(t)), catalog_df(t.spark, CLINICAL_CONCEPTS)
    flow.run_flow(events, f"{out}/tables", f"{out}/checkpoint", catalog, "pepper", **clinic_options(t, out)).awaitTermination()
    return f"{out}/tables"


#: Visits that pass the flow, with the best of all known texts of the tenant for those without a record number.
CLINIC_SQL = """seen AS (SELECT *, CASE WHEN mrn IS NULL THEN nullif(trim(patient), '') END AS asked FROM clinic_visits WHERE id % 23 <> 0 AND id % 19 <> 0),
    scored AS (SELECT a.tenant_id, a.asked, l.master_id, round(jaro_winkler_similarity(l.patient_id, a.asked), 10) AS score
               FROM (SELECT DISTINCT tenant_id, asked FROM seen WHERE asked IS NOT NULL) a JOIN clinic_links l ON l.tenant_id = a.tenant_id),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, asked ORDER BY score DESC, master_id) AS n FROM scored WHERE score >= 0.85) x WHERE n = 1),
    linked AS (SELECT s.*, CAST(coalesce(b.score, 1.0) AS DOUBLE) AS score,
                 CASE WHEN mrn IS NOT NULL THEN 'deterministic' WHEN b.asked IS NOT NULL THEN 'probabilistic' ELSE 'new' END AS method,
                 CASE WHEN mrn IS NOT NULL THEN concat('m-', reg_id) WHEN b.asked IS NOT NULL THEN b.master_id
                      ELSE concat('master-', substr(sha256(coalesce(s.tenant_id || '|' || s.asked, CAST(s.id AS VARCHAR))), 1, 16)) END AS master_id
               FROM seen s LEFT JOIN best b ON b.tenant_id = s.tenant_id AND b.asked = s.asked)"""


@plan(
    "g1_similar_masters",
    f"WITH {CLINIC_SQL} SELECT CAST(id AS VARCHAR) AS id, tenant_id, master_id, score, method, trim(patient) AS patient_id FROM linked",
    "clinic_visits",
    "clinic_links",
)
def _(t: Tables):
    out = run_clinic(t)
    facts, links = (flow.read_store(t.spark, out, name) for name in ("facts", "links"))
    # The id of a link is made of the master and the record.
    link_id = F.sha2(F.concat_ws("|", "master_id", "id"), 256)
    how = links.select(F.col("id").alias("_link"), "score", "method")
    joined = facts.withColumn("_link", link_id).join(how, "_link")
    return joined.select(F.col("id").cast("string").alias("id"), "tenant_id", "master_id", "score", "method", "patient_id")


@plan(
    "g1_tenant_drilldown",
    f"""WITH {CLINIC_SQL}, mine AS (SELECT *, trim(patient) AS p FROM linked WHERE tenant_id = 'tenant-1'),
        chosen AS (SELECT DISTINCT p FROM mine WHERE concept = 'blood-glucose' AND value >= 100 AND p <> ''),
        counts AS (SELECT trim(patient) AS p, count(*) AS link_count FROM linked GROUP BY ALL),
        first AS (SELECT trim(patient) AS p, day, min_by(concept, CAST(id AS VARCHAR)) AS concept FROM linked GROUP BY ALL),
        latest AS (SELECT p, max_by(concept, day) AS latest_concept FROM first GROUP BY p)
        SELECT CAST(m.id AS VARCHAR) AS id, m.p AS patient_id, latest_concept, link_count
        FROM mine m JOIN chosen USING (p) JOIN counts USING (p) JOIN latest USING (p)""",
    "clinic_visits",
    "clinic_links",
)
def _(t: Tables):
    out = run_clinic(t)
    facts = FactTable(t.spark, f"{out}/facts")
    facts.compact(facts.batches())
    rows, links = facts.read(), flow.read_store(t.spark, out, "links")
    features = KeyedFeatures(t.spark, f"{out}/features").read()
    high = [Clause("concept", "=", "blood-glucose"), Clause("value", ">=", 100), Clause("timestamp", ">=", "2024-02-01")]
    patients = cohort_patients(cohort_filter(rows, high, tenant="tenant-1"), 1_000_000).filter("patient_id <> ''")
    found = drilldown(rows, features.limit(0), features, links, patients, 1_000_000, tenant="tenant-1")
    return found.select(F.col("id").cast("string").alias("id"), "patient_id", F.col("features")["concept"].alias("latest_concept"), "link_count")


def damaged(sent: DataFrame) -> DataFrame:
    """Every ninth message has lost its end."""
    lost = F.expr("substr(value, 1, length(value) - 1)")
    return sent.select(F.when(F.col("key").cast("bigint") % 9 == 0, lost).otherwise(F.col("value")).alias("value"))


def mended(letters: DataFrame):
    """Whole messages again, and a known source in place of an unknown one; all other letters stay open."""
    renamed = F.when(F.col("reason").contains("'pharmacy'"), F.replace("raw", F.lit("pharmacy"), F.lit("hospital")))
    return F.when(F.col("stage") == "decode", F.concat("raw", F.lit("}"))).when(F.col("stage") == "validate", renamed)


@plan(
    "g1_replayed_letters",
    """WITH v AS (SELECT id, id % 9 = 0 AS cut, id % 23 = 0 AS unknown, id % 19 = 0 AS odd FROM clinic_visits)
       SELECT 'facts' AS name, count(*) AS n FROM v WHERE NOT odd AND NOT (cut AND unknown)
       UNION ALL SELECT 'decode', count(*) FROM v WHERE cut
       UNION ALL SELECT 'validate', count(*) FROM v WHERE unknown
       UNION ALL SELECT 'normalize', count(*) FROM v WHERE odd AND NOT (cut AND unknown)
       UNION ALL SELECT 'mended', count(*) FROM v WHERE cut OR unknown
       UNION ALL SELECT 'open', count(*) FROM v WHERE (odd AND NOT (cut AND unknown)) OR (cut AND unknown)""",
    "clinic_visits",
)
def _(t: Tables):
    folder = fresh_dir(t, "letters")
    out, catalog = f"{folder}/tables", catalog_df(t.spark, CLINICAL_CONCEPTS)
    options = clinic_options(t, folder)
    flow.run_flow(decode_events(damaged(clinic_stream(t))), out, f"{folder}/checkpoint", catalog, "pepper", **options).awaitTermination()
    flow.mend_letters(t.spark, out, mended)
    for _ in range(2):  # the second replay finds nothing new
        flow.replay_letters(t.spark, out, f"{folder}/replayed", catalog, "pepper", **options).awaitTermination()
    letters = flow.read_store(t.spark, out, "dead_letters").groupBy(F.col("stage").alias("name")).agg(F.count("*").alias("n"))
    for name, rows in {
        "facts": flow.read_store(t.spark, out, "facts"),
        "mended": t.spark.read.parquet(f"{out}/mended"),
        "open": flow.open_letters(t.spark, out),
    }.items():
        letters = letters.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return letters


@plan(
    "g2_request_status",
    """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 23 = 0 THEN 'pharmacy' ELSE 'hospital' END AS source, 'fhir' AS format,
         CASE WHEN id % 23 = 0 OR id % 19 = 0 THEN 'failed' ELSE 'published' END AS status,
         CASE WHEN id % 23 = 0 THEN 'source ''pharmacy'' not allowed: invalid source' WHEN id % 19 = 0 THEN 'resourceType ObservationX not allowed' END AS error,
         CAST(CASE WHEN id % 23 <> 0 THEN 0 ELSE -1 END AS INTEGER) AS match_count
       FROM clinic_visits""",
    "clinic_visits",
)
def _(t: Tables):
    out = run_clinic(t)
    found = flow.read_store(t.spark, out, "phi").select("id", "match_count")
    rows = flow.read_store(t.spark, out, "requests").join(found, "id", "left")
    return rows.select(F.col("id").cast("string").alias("id"), "source", "format", "status", "error", F.coalesce("match_count", F.lit(-1)).alias("match_count"))


#: Two stored batches with versions in common, and both again.
WRITES_SQL = """days AS (SELECT patient_id AS entity_id, CAST(extract(DAY FROM timestamp) AS BIGINT) AS version, concept, timestamp, id, id % 3 <> 2 AS late FROM facts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, version ORDER BY late, timestamp, id) AS n FROM days)"""


@plan("f2_first_write_wins", f"WITH {WRITES_SQL} SELECT entity_id, version, concept, id AS source_id FROM ranked WHERE n = 1", "facts")
def _(t: Tables):
    store = KeyedFeatures(t.spark, f"{fresh_dir(t, 'features')}/store")
    rows = t["facts"].select(
        F.col("patient_id").alias("entity_id"),
        F.dayofmonth("timestamp").cast("bigint").alias("version"),
        F.create_map(F.lit("concept"), F.col("concept")).alias("features"),
        F.col("timestamp").alias("created_at"),
        F.col("id").alias("source_id"),
    )
    first, second = rows.filter("source_id % 3 = 2"), rows
    for part, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        store.append(part, batch)
    return store.read().select("entity_id", "version", F.col("features")["concept"].alias("concept"), "source_id")


@plan(
    "s4_compacted_facts",
    """SELECT id, patient_id, concept, value, timestamp FROM facts
       WHERE resource_type = 'Observation' AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 12:00:00'""",
    "facts",
)
def _(t: Tables):
    table = FactTable(t.spark, fresh_dir(t, "facts"))
    for batch in range(4):
        table.append(t["facts"].filter(F.col("id") % 4 == batch), batch)
    table.compact([0, 1])
    table.compact([0, 1, 2])
    window = [Clause("resource_type", "=", "Observation"), Clause("timestamp", ">=", "2024-01-10"), Clause("timestamp", "<", "2024-01-20 12:00")]
    return cohort_filter(table.read(), window).select("id", "patient_id", "concept", "value", "timestamp")


@plan(
    "c12_cohort_to_store",
    """WITH m AS (SELECT patient_id, count(*) AS record_count, max_by(concept, row(timestamp, id)) AS latest_concept, max(timestamp) AS latest
            FROM facts WHERE concept = 'blood-glucose' AND value >= 30 GROUP BY patient_id)
       SELECT f.id, f.patient_id, CASE WHEN m.patient_id IS NULL THEN 'none' ELSE 'glucose' END AS cohort_id,
              CAST(coalesce(record_count, 0) AS INTEGER) AS record_count, coalesce(strftime(latest, '%Y-%m-%dT%H:%M:%SZ'), '') AS latest
       FROM facts f LEFT JOIN m USING (patient_id) WHERE f.resource_type = 'Procedure'""",
    "facts",
)
def _(t: Tables):
    """A cohort materialized twice into the store; the drill-down of all visits finds the newest version by patient."""
    store = KeyedFeatures(t.spark, f"{fresh_dir(t, 'cohort')}/features")
    spec = CohortQuery([Clause("concept", "=", "blood-glucose"), Clause("value", ">=", 30)])
    for number, (facts, at) in enumerate(((t["facts"].filter("id % 2 = 0"), "2024-02-01 00:00:00"), (t["facts"], "2024-02-02 00:00:00"))):
        store.append(cohort_features(materialize_cohort(facts, spec, "glucose"), clock(at)), number)
    stored, visits = store.read(), t["facts"].filter("resource_type = 'Procedure'")
    found = drilldown(visits, stored.limit(0), stored, t["fact_links"].limit(0), None, 1_000_000)
    feature = lambda name: F.col("features")[name]
    return found.select(
        "id", "patient_id", F.coalesce(feature("cohort_id"), F.lit("none")).alias("cohort_id"),
        F.coalesce(feature("record_count").cast("int"), F.lit(0)).alias("record_count"), F.coalesce(feature("latest_timestamp"), F.lit("")).alias("latest"),
    )


@plan(
    "f3_online_stream",
    """WITH r AS (SELECT *, max(created_at) OVER () AS now, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, version DESC) AS n FROM offline_features)
       SELECT entity_id, version, concept, created_at FROM r WHERE n = 1 AND created_at > now - INTERVAL '1' DAY""",
    "offline_features",
)
def _(t: Tables):
    out = fresh_dir(t, "online")
    facts = t.spark.sql(fixtures.STATEMENTS["facts"], events=event_stream(t))
    rows = t.spark.sql(fixtures.STATEMENTS["offline_features"], facts=facts)
    rows = rows.select("entity_id", "version", F.create_map(F.lit("concept"), F.col("concept")).alias("features"), "created_at", "source_id")
    run_online(rows, f"{out}/changes", f"{out}/checkpoint", timedelta(days=1)).awaitTermination()
    newest = t["events"].agg(F.max("ts")).first()[0]
    view = read_online(t.spark, f"{out}/changes", F.lit(newest).cast("timestamp_ntz"), timedelta(days=1))
    return view.select("entity_id", "version", F.col("features")["concept"].alias("concept"), "created_at")
