"""Cohort queries over the fact table: typed filters, projection, counts, timelines and materialization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.functions.groups import top_n_per_key
from vitalweave.functions.scalars import all_of, number, present, utc_text
from vitalweave.operators.features import latest_features, resolve_features
from vitalweave.operators.linkage import linkage_summary

# Queryable fields with their kind, operators, default projection and result sizes.
FIELDS = {
    "patient_id": "string",
    "master_id": "string",
    "resource_type": "string",
    "concept": "string",
    "unit": "string",
    "value": "numeric",
    "timestamp": "time",
    "code_loinc": "string",
    "code_snomed": "string",
}
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "in")
DEFAULT_FIELDS = ("patient_id", "resource_type", "concept", "value", "timestamp")
PUBLIC = "public"
PATIENT_PAGE, RECORD_SAMPLE, SLICE_ROWS, TIMELINE_ROWS = 500, 200, 200, 500
TEMPLATE_ROWS, MATERIALIZATION_ROWS = 25, 50
MAX_COHORTS = 10_000
# Facts keep concepts in lower case and types in title case. Literals are put into the
# stored form, so a comparison ignores case and still reaches the file scan.
STORED_FORM = {"concept": str.lower, "resource_type": str.title}
TIME_LAYOUTS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M", "%Y-%m-%d")


@dataclass(frozen=True)
class Clause:
    """``field op value``; ``in`` takes a sequence or comma-separated text."""

    field: str
    op: str
    value: object


class BadClause(ValueError):
    """An unknown field or operator, or a literal that does not fit the field."""


def _time_literal(text: str, clause: Clause) -> datetime:
    for layout in TIME_LAYOUTS:
        try:
            parsed = datetime.strptime(text, layout)
        except ValueError:
            continue
        return parsed.astimezone(timezone.utc).replace(tzinfo=None) if parsed.tzinfo else parsed
    raise BadClause(f"{clause}: not a time")


def literal_value(clause: Clause, value: object) -> str | float | datetime:
    """A literal as the field keeps it: text in its stored form, a number, or a UTC clock time."""
    if isinstance(value, datetime):
        text = value.isoformat(sep=" ", timespec="minutes")
    else:
        text = str(value).strip().strip("'\"")
    if text == "":
        raise BadClause(f"{clause}: empty literal")
    shape = FIELDS[clause.field]
    if shape == "numeric":
        try:
            return float(text)
        except ValueError as error:
            raise BadClause(f"{clause}: not a number") from error
    if shape == "time":
        return value if isinstance(value, datetime) and value.tzinfo is None else _time_literal(text, clause)
    return STORED_FORM.get(clause.field, str)(text)


def literal_values(clause: Clause) -> list[str | float | datetime]:
    """All literals of a clause; raises :class:`BadClause` when it cannot hold its meaning."""
    if clause.field not in FIELDS:
        raise BadClause(f"{clause}: unknown field")
    if clause.op not in OPERATORS:
        raise BadClause(f"{clause}: unknown operator")
    if clause.op != "in":
        return [literal_value(clause, clause.value)]
    values = clause.value
    if isinstance(values, str):
        values = values.strip().strip("()[]").split(",")
    literals = [literal_value(clause, v) for v in values]
    if not literals:
        raise BadClause(f"{clause}: empty list")
    return literals


def _as_column(literal: str | float | datetime, kind: T.DataType) -> Column:
    if isinstance(literal, datetime):
        clock = literal.isoformat(sep=" ")
        if isinstance(kind, T.TimestampType):
            return F.lit(clock + "Z").cast("timestamp")
        return F.lit(clock).cast("timestamp_ntz")
    return F.lit(literal)


def predicate(facts: DataFrame, clause: Clause) -> Column:
    """The clause as a Column; raises :class:`BadClause` when it cannot hold its meaning."""
    if clause.field not in facts.columns:
        raise BadClause(f"{clause}: unknown field")
    kind = facts.schema[clause.field].dataType if clause.field in FIELDS else None
    literals = [_as_column(x, kind) for x in literal_values(clause)]
    column = number(facts, clause.field) if FIELDS[clause.field] == "numeric" else F.col(clause.field)
    compared = column.isin(literals) if clause.op == "in" else _compared(column, clause.op, literals[0])
    return compared & _day_bound(facts, clause, literals)


def _compared(column: Column, op: str, literal: Column) -> Column:
    return {
        "=": column == literal,
        "!=": column != literal,
        ">": column > literal,
        "<": column < literal,
        ">=": column >= literal,
        "<=": column <= literal,
    }[op]


def _day_bound(facts: DataFrame, clause: Clause, literals: Sequence[Column]) -> Column:
    """What a time clause means for the day that facts are stored by, so that the scan leaves out all other days."""
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    stored = isinstance(kinds.get("event_date"), T.DateType) and isinstance(kinds.get(clause.field), T.TimestampNTZType)
    if not stored or clause.op == "!=":
        return F.lit(True)
    day, days = F.col("event_date"), [F.to_date(x) for x in literals]
    if clause.op in ("=", "in"):
        return day.isin(days)
    return day >= days[0] if clause.op in (">", ">=") else day <= days[0]


def dropped_clauses(facts: DataFrame, clauses: Sequence[Clause]) -> list[Clause]:
    """Clauses that a lenient filter leaves out."""
    dropped = []
    for clause in clauses:
        try:
            predicate(facts, clause)
        except BadClause:
            dropped.append(clause)
    return dropped


def tenant_view(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant. None asks for all of them; a blank name is the public tenant."""
    if tenant is None:
        return df
    return df.filter(F.col("tenant_id") == (tenant.strip() or PUBLIC))


def tenant_of(canonical: Column, codes: Column) -> Column:
    """Tenant named in the canonical map, else in the codes, else ``public``."""
    return F.coalesce(present(canonical["tenant_id"]), present(codes["tenant_id"]), F.lit(PUBLIC))


def cohort_filter(
    facts: DataFrame, clauses: Sequence[Clause], tenant: str | None = None, strict: bool = True
) -> DataFrame:
    """Facts for which all clauses hold. Lenient mode leaves bad clauses out (see :func:`dropped_clauses`)."""
    kept = [c for c in clauses if strict or c not in dropped_clauses(facts, [c])]
    return tenant_view(facts, tenant).filter(all_of(predicate(facts, c) for c in kept))


def cohort_project(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """Requested fields; a field the facts lack is null."""
    return df.select(
        *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields or DEFAULT_FIELDS]
    )


def cohort_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("patient_id").alias("patient_count"))


def cohort_patients(df: DataFrame, limit: int = PATIENT_PAGE) -> DataFrame:
    return df.select("patient_id").distinct().orderBy("patient_id").limit(limit)


def cohort_records(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, limit: int = RECORD_SAMPLE) -> DataFrame:
    newest = df.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return cohort_project(newest, fields)


def rollup_rows(facts: DataFrame) -> DataFrame:
    """One rollup row for each fact; the metric is the lower-cased type."""
    metric = F.lower("resource_type")
    return facts.select(
        F.concat_ws(":", "master_id", "resource_type", F.col("id").cast("string")).alias("id"),
        "master_id",
        "patient_id",
        metric.alias("metric"),
        "concept",
        "value",
        "unit",
        F.col("timestamp").alias("event_time"),
    )


def slice_rollups(
    rollups: DataFrame, metric: str | None = None, patient: str | None = None, n: int = SLICE_ROWS
) -> DataFrame:
    """Newest rollups of a metric, a patient or both."""
    rows = rollups
    if metric:
        rows = rows.filter(F.col("metric") == metric)
    if patient:
        rows = rows.filter(F.col("patient_id") == patient)
    return rows.orderBy(F.desc("event_time"), F.desc("id")).limit(n)


@dataclass(frozen=True)
class CohortQuery:
    clauses: Sequence[Clause] = ()
    fields: Sequence[str] = DEFAULT_FIELDS
    tenant: str | None = None
    limit: int = PATIENT_PAGE
    strict: bool = True
    records: int = RECORD_SAMPLE
    slices: int = SLICE_ROWS
    metric: str | None = None


def cohort_query(facts: DataFrame, spec: CohortQuery) -> dict[str, DataFrame]:
    """Count, patients, sample records and rollup slices of one filtered cohort.

    ``limit``, ``records`` and ``slices`` are the sizes of the patient page, of the sample and of
    the slices, each as given. The slices are the newest rollups of the tenant, of the given metric and of the
    patient that a clause fixes. Persist ``rows`` before running several of the parts.
    """
    rows = cohort_filter(facts, spec.clauses, spec.tenant, spec.strict)
    fixed = {c.field: str(c.value).strip().strip("'\"") for c in spec.clauses if c.op == "="}
    return {
        "rows": rows,
        "count": cohort_count(rows),
        "patients": cohort_patients(rows, spec.limit),
        "records": cohort_records(rows, spec.fields, spec.records),
        "slices": slice_rollups(rollup_rows(tenant_view(facts, spec.tenant)), spec.metric, fixed.get("patient_id"), spec.slices),
    }


def timeline(facts: DataFrame, patients: DataFrame | None = None, n: int = TIMELINE_ROWS, tenant: str | None = None) -> DataFrame:
    """Oldest ``n`` facts of each patient, of the listed patients when given, in the view of a tenant."""
    facts = tenant_view(facts, tenant)
    wanted = facts if patients is None else facts.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    return top_n_per_key(wanted, ["patient_id"], [F.asc("timestamp"), F.asc("id")], n)


def drilldown(
    facts: DataFrame,
    online: DataFrame,
    offline: DataFrame,
    links: DataFrame,
    patients: DataFrame | None = None,
    n: int = TIMELINE_ROWS,
    tenant: str | None = None,
) -> DataFrame:
    """Timeline rows with the patient's resolved features and linkage summary beside them.

    Features are rows of (entity_id, features). Both sides are one row per patient
    and the timeline is at most ``n`` rows per patient before it is joined. A list of
    patients narrows all inputs before anything is aggregated. With a tenant, only its facts
    are seen, and of the other inputs only what has no tenant or is its own.
    """
    if tenant is not None:
        facts = tenant_view(facts, tenant)
        online, offline, links = (tenant_view(df, tenant) if "tenant_id" in df.columns else df for df in (online, offline, links))
    if patients is not None:
        patients = patients.select("patient_id").distinct()
        entities = patients.select(F.col("patient_id").alias("entity_id"))
        online, offline = (df.join(entities, "entity_id", "left_semi") for df in (online, offline))
        links = links.join(patients, "patient_id", "left_semi")
    events = timeline(facts, patients, n)
    known = resolve_features(online, latest_features(offline)).select(
        F.col("entity_id").alias("patient_id"), "features", "feature_source"
    )
    summary = linkage_summary(links).select(
        "patient_id",
        F.col("master_id").alias("master_patient_id"),
        "primary_score",
        F.col("method").alias("link_method"),
        "link_count",
        "linked_patients",
    )
    return events.join(known, "patient_id", "left").join(summary, "patient_id", "left")


def materialize_cohort(facts: DataFrame, spec: CohortQuery, cohort_id: str) -> DataFrame:
    """Per patient: record count, newest concept, value and time, and mean of the numeric values."""
    rows = cohort_filter(facts, spec.clauses, spec.tenant, spec.strict)
    newest = F.max_by(F.struct("concept", "value", "timestamp"), F.struct("timestamp", "id"))
    grouped = rows.withColumn("_number", number(rows, "value")).groupBy("patient_id").agg(
        F.count("*").alias("record_count"), newest.alias("_newest"), F.avg("_number").alias("average_value")
    )
    return grouped.select(
        F.lit(cohort_id).alias("cohort_id"),
        "patient_id",
        "record_count",
        F.col("_newest.concept").alias("latest_concept"),
        F.col("_newest.value").alias("latest_value"),
        F.col("_newest.timestamp").alias("latest_timestamp"),
        "average_value",
    )


def cohort_features(materialized: DataFrame, materialized_at: Column) -> DataFrame:
    """Materialized rows as versions for the feature store, one of each patient, under the patient's id.

    The version is the time of the materialization in microseconds; empty values have no entry.
    """
    pairs = {
        "cohort_id": F.col("cohort_id"),
        "patient_id": F.col("patient_id"),
        "record_count": F.col("record_count").cast("string"),
        "materialized_at": utc_text(materialized_at),
        "latest_concept": F.col("latest_concept"),
        "latest_value": F.col("latest_value").cast("string"),
        "latest_timestamp": utc_text("latest_timestamp"),
        "average_value": F.col("average_value").cast("string"),
    }
    flat = [part for name, value in pairs.items() for part in (F.lit(name), value)]
    known = materialized.filter(present("patient_id").isNotNull())
    return known.select(
        F.col("patient_id").alias("entity_id"),
        F.unix_micros(materialized_at.cast("timestamp")).alias("version"),
        F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull()).alias("features"),
        materialized_at.alias("created_at"),
        F.col("cohort_id").alias("source_id"),
    )


def clauses_of(table: DataFrame, limit: int = MAX_COHORTS) -> dict[str, list[Clause]]:
    """Saved cohorts from rows of (cohort_id, field, op, value). They become part of the plan, hence the check."""
    rows = table.select("cohort_id", "field", "op", "value").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} cohort clauses")
    cohorts: dict[str, list[Clause]] = {}
    for row in rows:
        cohorts.setdefault(row["cohort_id"], []).append(Clause(row["field"], row["op"], row["value"]))
    return cohorts


def evaluate_cohorts(
    facts: DataFrame, cohorts: Mapping[str, Sequence[Clause]], tenant: str | None = None, strict: bool = True
) -> DataFrame:
    """(cohort_id, patient_id) for many cohorts in a single scan.

    Each fact tests all cohorts in place, so nothing is joined; only the distinct
    pairs are shuffled, after map-side combine.
    """
    rows = tenant_view(facts, tenant)
    hits = []
    for cohort_id, clauses in cohorts.items():
        kept = [c for c in clauses if strict or c not in dropped_clauses(facts, [c])]
        hits.append(F.when(all_of(predicate(facts, c) for c in kept), F.lit(cohort_id)))
    if not hits:
        raise ValueError("no cohorts given")
    found = rows.select("patient_id", F.explode(F.array_compact(F.array(*hits))).alias("cohort_id"))
    return found.select("cohort_id", "patient_id").distinct()


def _visible(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if not tenant else df.filter(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))


def visible_templates(df: DataFrame, tenant: str | None, n: int = TEMPLATE_ROWS) -> DataFrame:
    """Newest templates that the tenant owns or that are shared."""
    return _visible(df, tenant).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def visible_materializations(df: DataFrame, tenant: str | None, n: int = MATERIALIZATION_ROWS) -> DataFrame:
    return _visible(df, tenant).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def materialization_counts(df: DataFrame, tenant: str | None) -> DataFrame:
    return _visible(df, tenant).groupBy("status").agg(F.count("*").alias("jobs"))


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order; sizes and numbers below one count as one."""
    size, number = max(size, 1), max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
