"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalweave.functions import scalars as S
from vitalweave.functions.similarity import jaro_winkler
from vitalweave.operators.privacy import find_all, replace_all
from vitalweave.plans.registry import Tables, plan
from vitalweave.sources.reference_data import DEFAULT_RULES
from vitalweave.sources.tables import export_rows

EMAIL = next(r for r in DEFAULT_RULES if r.type == "email")
NUMBER_SQL = r"regexp_matches(trim({0}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


@plan(
    "x1_trim_lower_fold",
    """SELECT id, lower(trim(source)) AS source, lower(trim(format)) AS format,
       lower(trim(source)) = 'hospital' AS is_hospital FROM arrivals""",
    "arrivals",
)
def _(t: Tables):
    return t["arrivals"].select(
        "id",
        S.clean_lower("source").alias("source"),
        S.clean_lower("format").alias("format"),
        S.equal_fold(S.clean("source"), F.lit("Hospital")).alias("is_hospital"),
    )


@plan("x2_strip_quotes", """SELECT o_orderkey AS id, concat(o_orderpriority, '') AS literal FROM orders""")
def _(t: Tables):
    quoted = F.concat(F.lit(" '\""), F.col("o_orderpriority"), F.lit("\"' "))
    return t["orders"].select(F.col("o_orderkey").alias("id"), S.strip_quotes(quoted).alias("literal"))


@plan(
    "x3_numeric_text",
    f"""SELECT id, CASE WHEN {NUMBER_SQL.format('value')} THEN CAST(trim(value) AS DOUBLE) END AS value FROM mixed_facts""",
    "mixed_facts",
)
def _(t: Tables):
    facts = t["mixed_facts"]
    return facts.select("id", S.number(facts, "value").alias("value"))


@plan(
    "x4_time_text",
    """SELECT event_id AS id, CASE event_id % 4
         WHEN 0 THEN date_trunc('second', ts) - INTERVAL '2' HOUR
         WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) END AS at FROM events""",
)
def _(t: Tables):
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", " yyyy-MM-dd "))
        .otherwise(F.lit("yesterday"))
    )
    return t["events"].select(F.col("event_id").alias("id"), S.parse_time(text).alias("at"))


@plan("x5_json_field", "SELECT event_id AS id, props ->> '$.k' AS k, props ->> '$.none' AS absent FROM events")
def _(t: Tables):
    return t["events"].select(
        F.col("event_id").alias("id"),
        S.json_text("props", "$.k").alias("k"),
        S.json_text("props", "$.none").alias("absent"),
    )


@plan(
    "x6_time_arithmetic",
    """SELECT id, date_trunc('minute', updated_at) AS minute, CAST(updated_at AS DATE) = CAST(created_at AS DATE) AS same_day,
       epoch(updated_at - created_at) AS seconds FROM requests""",
    "requests",
)
def _(t: Tables):
    return t["requests"].select(
        "id",
        F.date_trunc("minute", "updated_at").cast("timestamp_ntz").alias("minute"),
        (F.to_date("updated_at") == F.to_date("created_at")).alias("same_day"),
        S.seconds_between("created_at", "updated_at").alias("seconds"),
    )


@plan("x7_blank_default", "SELECT id, coalesce(nullif(trim(error), ''), 'Unknown reason') AS reason FROM requests", "requests")
def _(t: Tables):
    return t["requests"].select("id", S.blank_to("error", "Unknown reason").alias("reason"))


@plan(
    "x8_regex_all",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL.pattern}')) AS BIGINT) AS found,
       regexp_replace(text, '{EMAIL.pattern}', '{EMAIL.mask}', 'g') AS masked FROM documents""",
)
def _(t: Tables):
    return t["documents"].select(
        "doc_id",
        F.size(find_all(F.col("text"), EMAIL)).cast("bigint").alias("found"),
        replace_all(F.col("text"), [EMAIL]).alias("masked"),
    )


@plan("x9_salted_token", "SELECT doc_id, concat('token_', substr(sha256(concat('pepper:', text)), 1, 16)) AS token FROM documents")
def _(t: Tables):
    return t["documents"].select("doc_id", S.token("text", "pepper").alias("token"))


@plan(
    "x10_jaro_winkler",
    """SELECT i.inc_id, round(jaro_winkler_similarity(r.patient_id, trim(i.patient_id)), 10) AS score
       FROM incoming i JOIN registry r ON r.reg_id = i.inc_id""",
    "incoming",
    "registry",
)
def _(t: Tables):
    known = t["registry"].select(F.col("reg_id").alias("inc_id"), F.col("patient_id").alias("known"))
    pairs = t["incoming"].join(known, "inc_id")
    return pairs.select("inc_id", F.round(jaro_winkler("known", S.clean("patient_id")), 10).alias("score"))


@plan(
    "x11_sigmoid_log",
    """SELECT event_id AS id, round(1 / (1 + exp(-(value - 120) / 50)), 10) AS p, round(ln(value + 1), 10) AS log_value FROM events""",
)
def _(t: Tables):
    return t["events"].select(
        F.col("event_id").alias("id"),
        F.round(S.sigmoid((F.col("value") - 120) / 50), 10).alias("p"),
        F.round(F.log(F.col("value") + 1), 10).alias("log_value"),
    )


@plan(
    "x12_export_text",
    """SELECT CAST(id AS VARCHAR) AS id, coalesce(printf('%.6f', value), '') AS value,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, coalesce(unit, '') AS unit, '' AS absent FROM facts""",
    "facts",
)
def _(t: Tables):
    return export_rows(t["facts"], ["id", "value", "timestamp", "unit", "absent"])


@plan(
    "x13_text_parts",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS last_part, contains(url, 'page=') AS has_page FROM pages""",
)
def _(t: Tables):
    return t["pages"].select(
        "page_id", S.last_part("url").alias("last_part"), F.contains("url", F.lit("page=")).alias("has_page")
    )


@plan(
    "x13_title_case",
    "SELECT p_partkey, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS title FROM part",
)
def _(t: Tables):
    return t["part"].select("p_partkey", S.title_case("p_type").alias("title"))


@plan(
    "x14_slug",
    """SELECT page_id, coalesce(nullif(regexp_replace(lower(trim(url)), '[^a-z0-9_-]', '-', 'g'), ''), 'cohort-export') AS slug FROM pages""",
)
def _(t: Tables):
    return t["pages"].select("page_id", S.slug("url").alias("slug"))


@plan("x15_utc_text", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(t: Tables):
    return t["events"].select(F.col("event_id").alias("id"), S.utc_text("ts").alias("at"))
