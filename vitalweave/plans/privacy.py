"""Detection, masking, tokens, vault and anonymity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from vitalweave.operators import privacy as P
from vitalweave.plans.registry import Tables, plan
from vitalweave.sources.reference_data import CLINICAL_CONCEPTS, CLINICAL_RULES, catalog_df, rules_df

SALT = "pepper"
COLUMNS = ("note", "contact")


def matches_sql(table: str, id: str, columns: Sequence[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {id}, '{c}' AS path, '{r.type}' AS type, '{r.mask}' AS mask, "
        f"unnest(regexp_extract_all({c}, '{r.pattern}')) AS value FROM {table}"
        for c in columns
        for r in CLINICAL_RULES
    )


def positions_sql(table: str, id: str, columns: Sequence[str]) -> str:
    parts = [
        f"SELECT {id}, '{c}' AS path, '{r.type}' AS type, string_split_regex({c}, '{r.pattern}') AS pieces, "
        f"regexp_extract_all({c}, '{r.pattern}') AS vals FROM {table}"
        for c in columns
        for r in CLINICAL_RULES
    ]
    return f"""WITH cut AS ({' UNION ALL '.join(parts)}),
        each AS (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM cut),
        placed AS (SELECT *, coalesce(list_sum([strlen(p) for p in pieces[1:i]]), 0)
                          + coalesce(list_sum([strlen(v) for v in vals[1:i - 1]]), 0) AS start_at FROM each)
        SELECT {id}, path, type, CAST(start_at AS BIGINT) AS start, CAST(start_at + strlen(vals[i]) AS BIGINT) AS "end",
               vals[i] AS value FROM placed"""


def masked_sql(column: str) -> str:
    text = column
    for r in CLINICAL_RULES:
        text = f"regexp_replace({text}, '{r.pattern}', '{r.mask}', 'g')"
    return text


def values_sql(columns: Sequence[str]) -> str:
    """All values detected in the record, as one list."""
    lists = [f"regexp_extract_all({c}, '{r.pattern}')" for c in columns for r in CLINICAL_RULES]
    text = lists[0]
    for item in lists[1:]:
        text = f"list_concat({text}, {item})"
    return text


TOKEN_SQL = f"concat('token_', substr(sha256(concat('{SALT}:', {{0}})), 1, 16))"
HIT_SQL = "len([v for v in vals if contains({0}, v)]) > 0"


@plan("p1_detect_phi", matches_sql("phi_records", "record_id", COLUMNS), "phi_records")
def _(t: Tables):
    return P.detect_phi(t["phi_records"], "record_id", COLUMNS)


@plan("p1_detect_documents", matches_sql("documents", "doc_id", ["text"]))
def _(t: Tables):
    return P.detect_phi(t["documents"], "doc_id", ["text"])


@plan("p2_phi_positions", positions_sql("phi_records", "record_id", COLUMNS), "phi_records")
def _(t: Tables):
    return P.phi_positions(t["phi_records"], "record_id", COLUMNS)


@plan("p2_phi_offsets", positions_sql("phi_records", "record_id", COLUMNS), "phi_records")
def _(t: Tables):
    return P.phi_offsets(t["phi_records"], "record_id", COLUMNS)


@plan("p2_page_offsets", positions_sql("pages", "page_id", ["html"]))
def _(t: Tables):
    return P.phi_offsets(t["pages"], "page_id", ["html"])


@plan("p2_page_positions", positions_sql("pages", "page_id", ["html"]))
def _(t: Tables):
    return P.phi_positions(t["pages"], "page_id", ["html"])


@plan(
    "p3_string_leaves",
    """SELECT record_id, 'r.note' AS path, note AS text FROM phi_records
       UNION ALL SELECT record_id, 'r.visits', CAST(visits AS VARCHAR) FROM phi_records
       UNION ALL SELECT record_id, 'tags', contact FROM phi_records
       UNION ALL SELECT record_id, 'tags', patient_id FROM phi_records
       UNION ALL SELECT record_id, 'extra.owner', patient_id FROM phi_records""",
    "phi_records",
)
def _(t: Tables):
    nested = t["phi_records"].select(
        "record_id",
        F.struct("note", "visits").alias("r"),
        F.array("contact", "patient_id").alias("tags"),
        F.create_map(F.lit("owner"), F.col("patient_id")).alias("extra"),
    )
    return P.string_leaves(nested, "record_id", ["r", "tags", "extra"])


@plan(
    "p4_phi_summary",
    f"""WITH found AS ({matches_sql('phi_records', 'record_id', COLUMNS)}),
        grouped AS (SELECT record_id, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS phi_types,
                           string_agg(DISTINCT mask, ',' ORDER BY mask) AS suggestions FROM found GROUP BY record_id)
        SELECT r.record_id, coalesce(n, 0) > 0 AS detected, coalesce(n, 0) AS match_count,
               CASE WHEN n IS NULL THEN 0.0 WHEN n = 1 THEN 0.7 WHEN n = 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence,
               coalesce(phi_types, '') AS phi_types, coalesce(suggestions, '') AS suggestions
        FROM phi_records r LEFT JOIN grouped USING (record_id)""",
    "phi_records",
)
def _(t: Tables):
    rows = P.phi_summary(t["phi_records"], "record_id", COLUMNS)
    return rows.withColumns(
        {
            "match_count": F.col("match_count").cast("bigint"),
            "phi_types": F.array_join("phi_types", ","),
            "suggestions": F.array_join("suggestions", ","),
        }
    )


@plan(
    "p5_phi_confidence",
    """SELECT l_linenumber AS n, count(*) AS rows,
       CASE WHEN l_linenumber - 1 = 0 THEN 0.0 WHEN l_linenumber - 1 = 1 THEN 0.7 WHEN l_linenumber - 1 = 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence
       FROM lineitem GROUP BY l_linenumber""",
)
def _(t: Tables):
    counts = t["lineitem"].groupBy(F.col("l_linenumber").alias("n")).agg(F.count("*").alias("rows"))
    return counts.withColumn("confidence", P.phi_confidence(F.col("n") - 1))


@plan(
    "p6_mask_phi",
    f"SELECT record_id, {masked_sql('note')} AS note, {masked_sql('contact')} AS contact, visits FROM phi_records",
    "phi_records",
)
def _(t: Tables):
    return P.mask_phi(t["phi_records"], COLUMNS).select("record_id", "note", "contact", "visits")


@plan("p6_mask_documents", f"SELECT doc_id, {masked_sql('text')} AS text FROM documents")
def _(t: Tables):
    return P.mask_phi(t["documents"].select("doc_id", "text"), ["text"])


@plan(
    "p6_mask_nested",
    f"""SELECT record_id, {masked_sql('note')} AS note, {masked_sql('contact')} AS first_tag, {masked_sql('note')} AS copied, visits
        FROM phi_records""",
    "phi_records",
)
def _(t: Tables):
    nested = t["phi_records"].select(
        "record_id",
        F.struct("note", "visits").alias("r"),
        F.array("contact").alias("tags"),
        F.create_map(F.lit("copy"), F.col("note")).alias("extra"),
    )
    masked = P.mask_phi(nested, ["r", "tags", "extra"])
    return masked.select(
        "record_id",
        "r.note",
        F.col("tags")[0].alias("first_tag"),
        F.col("extra")["copy"].alias("copied"),
        "r.visits",
    )


@plan(
    "p7_tokenize",
    f"""WITH found AS (SELECT *, {values_sql(COLUMNS)} AS vals FROM phi_records)
        SELECT record_id,
               CASE WHEN {HIT_SQL.format('note')} THEN {TOKEN_SQL.format('note')} ELSE note END AS note,
               CASE WHEN {HIT_SQL.format('contact')} THEN {TOKEN_SQL.format('contact')} ELSE contact END AS contact
        FROM found""",
    "phi_records",
)
def _(t: Tables):
    return P.tokenize(t["phi_records"], COLUMNS, SALT).select("record_id", "note", "contact")


@plan(
    "p8_vault_rows",
    f"""WITH found AS (SELECT *, {values_sql(COLUMNS)} AS vals FROM phi_records),
        texts AS (SELECT note AS value FROM found WHERE {HIT_SQL.format('note')}
                  UNION SELECT contact FROM found WHERE {HIT_SQL.format('contact')}),
        stored AS (SELECT DISTINCT note AS value FROM phi_records WHERE len({values_sql(['note'])}) > 0)
        SELECT {TOKEN_SQL.format('value')} AS token, value FROM texts WHERE value NOT IN (SELECT value FROM stored)""",
    "phi_records",
)
def _(t: Tables):
    records = t["phi_records"]
    stored = P.vault_rows(records.select("note"), ["note"], SALT)
    return P.vault_rows(records, COLUMNS, SALT, existing=stored)


@plan(
    "p9_reidentify",
    f"SELECT record_id, CASE WHEN len({values_sql(['note'])}) > 0 THEN note END AS original FROM phi_notes",
    "phi_notes",
)
def _(t: Tables):
    notes = t["phi_notes"].select("record_id", "note")
    vault = P.vault_rows(notes, ["note"], SALT)
    return P.reidentify(P.tokenize(notes, ["note"], SALT), vault, "note").select("record_id", "original")


@plan(
    "p10_anonymity_report",
    """WITH g AS (SELECT study_id, status, count(*) AS n, count(DISTINCT site_id) AS kinds FROM subjects GROUP BY study_id, status)
       SELECT count(*) AS group_count, min(n) AS k, min(kinds) AS l, max(n) AS largest_group FROM g""",
    "subjects",
)
def _(t: Tables):
    return P.anonymity_report(t["subjects"], ["study_id", "status"], "site_id")


@plan(
    "p11_suppress_small_groups",
    """SELECT subject_id, study_id, status FROM (SELECT *, count(*) OVER (PARTITION BY study_id, status) AS n FROM subjects) x WHERE n >= 12""",
    "subjects",
)
def _(t: Tables):
    rows = P.suppress_small_groups(t["subjects"], ["study_id", "status"], 12)
    return rows.select("subject_id", "study_id", "status")


@plan(
    "s8_rules_in_use",
    " UNION ALL ".join(
        f"SELECT '{r.type}' AS type, '{r.severity}' AS severity, count(*) AS records FROM phi_notes WHERE regexp_matches(note, '{r.pattern}')"
        for r in CLINICAL_RULES
    ),
    "phi_notes",
)
def _(t: Tables):
    rules = rules_df(t.spark, CLINICAL_RULES).select("type", "severity")
    found = P.detect_phi(t["phi_notes"], "record_id", ["note"])
    counts = found.groupBy("type").agg(F.count_distinct("record_id").alias("records"))
    return rules.join(counts, "type", "left").na.fill(0, ["records"])


@plan(
    "s8_catalog_in_use",
    "SELECT c.concept, c.display, count(f.id) AS facts FROM catalog c LEFT JOIN facts f ON f.concept = c.concept GROUP BY ALL",
    "facts",
    "catalog",
)
def _(t: Tables):
    used = t["facts"].groupBy("concept").agg(F.count("*").alias("facts"))
    catalog = catalog_df(t.spark, CLINICAL_CONCEPTS).select("concept", "display")
    return catalog.join(used, "concept", "left").na.fill(0, ["facts"])
