"""Routing of clinical resources to canonical records, and terminology codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.once import evaluate_once
from vitalweave.functions.scalars import clean_lower, first_present, last_part, present, rfc3339_time, title_case

# Fields of a resource payload that reach the canonical record.
PAYLOAD = (
    "resourceType string, patient_id string, subject struct<reference:string>, effectiveDateTime string, "
    "code struct<text:string,display:string>, concept string, value string, unit string, "
    "valueQuantity struct<value:string,unit:string>, description string, recordedDate string, "
    "clinicalStatus struct<text:string>, performedDateTime string, tenant_id string, mrn string"
)
PUBLIC = "public"
# Resource types that have a canonical form.
SUPPORTED = ("observation", "condition", "procedure")
# Code systems in catalog column order.
SYSTEMS = {"SNOMED": "snomed", "LOINC": "loinc", "ICD10": "icd10"}


def select_payload(df: DataFrame, schema: str = PAYLOAD) -> DataFrame:
    """Adds ``payload``: tokenized data, else sanitized data, else tokenized text that holds JSON.

    The three sources are JSON texts; ``reason`` is set when none of them decodes.
    """
    def decoded(name: str) -> Column:
        text = F.col(name)
        return F.when(clean_lower(text).startswith("{"), F.from_json(text, schema))

    # A JSON string literal wraps a document once more; its text is what get_json_object returns.
    wrapped = F.get_json_object(F.concat(F.lit('{"t":'), F.col("tokenized_data"), F.lit("}")), "$.t")
    quoted = F.when(clean_lower("tokenized_data").startswith('"'), F.from_json(wrapped, schema))
    payload = F.coalesce(decoded("tokenized_data"), decoded("sanitized_data"), quoted)
    return evaluate_once(df, {"payload": payload}).withColumn(
        "reason", F.when(F.col("payload").isNull(), F.lit("tokenized data not present"))
    )


def route_resources(df: DataFrame, allowed: Sequence[str] = SUPPORTED, kind: str = "payload.resourceType") -> DataFrame:
    """Adds ``resource_key`` and ``reason`` for missing, not allowed and unsupported types."""
    names = [a.strip().lower() for a in allowed if a.strip()]
    ready = evaluate_once(df, {"_type": present(kind)})
    text, key = F.col("_type"), F.lower("_type")
    reason = F.when(text.isNull(), F.lit("resourceType missing"))
    if names:
        reason = reason.when(~key.isin(names), F.concat(F.lit("resourceType "), text, F.lit(" not allowed")))
    reason = reason.when(~key.isin(*SUPPORTED), F.concat(F.lit("resourceType "), text, F.lit(" unsupported")))
    return ready.withColumns({"resource_key": key, "reason": reason}).drop("_type")


def patient_ref(payload: str = "payload") -> Column:
    """Patient id, else the last path part of the subject reference, else empty text."""
    reference = last_part(present(f"{payload}.subject.reference"))
    return F.coalesce(present(f"{payload}.patient_id"), reference, F.lit(""))


def event_time(payload: str, received_at: Column) -> Column:
    """Effective time of the resource; the time of receipt when it is absent or unreadable."""
    return F.coalesce(rfc3339_time(f"{payload}.effectiveDateTime"), received_at)


def _lowered(*names: str) -> Column:
    return F.lower(F.coalesce(first_present(*names), F.lit("")))


def _text(name: str) -> Column:
    return F.coalesce(present(name), F.lit(""))


def observation_fields(payload: str = "payload") -> dict[str, Column]:
    return {
        "concept": _lowered(f"{payload}.code.text", f"{payload}.code.display", f"{payload}.concept"),
        "value": F.coalesce(F.col(f"{payload}.valueQuantity.value"), F.col(f"{payload}.value")),
        "unit": F.coalesce(F.col(f"{payload}.valueQuantity.unit"), F.col(f"{payload}.unit")),
        "effective": _text(f"{payload}.effectiveDateTime"),
    }


def condition_fields(payload: str = "payload") -> dict[str, Column]:
    return {
        "concept": _lowered(f"{payload}.description", f"{payload}.concept", f"{payload}.code.text"),
        "recorded_date": _text(f"{payload}.recordedDate"),
        "clinical_status": _text(f"{payload}.clinicalStatus.text"),
    }


def procedure_fields(payload: str = "payload") -> dict[str, Column]:
    return {
        "concept": _lowered(f"{payload}.description", f"{payload}.code.text"),
        "performed": _text(f"{payload}.performedDateTime"),
    }


def _canonical(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    rows = df.filter(clean_lower("payload.resourceType") == key)
    return rows.select("id", *[value.alias(name) for name, value in fields.items()])


def canonical_observation(df: DataFrame) -> DataFrame:
    return _canonical(df, "observation", observation_fields())


def canonical_condition(df: DataFrame) -> DataFrame:
    return _canonical(df, "condition", condition_fields())


def canonical_procedure(df: DataFrame) -> DataFrame:
    return _canonical(df, "procedure", procedure_fields())


def attach_codes(df: DataFrame, catalog: DataFrame, kind: str = "resource_type") -> DataFrame:
    """Adds snomed, loinc and icd10, null where the concept has no such code.

    Observations get all three systems, conditions no LOINC, procedures none.
    """
    key = F.lower(F.col("_concept"))
    terms = catalog.select(
        F.col("concept").alias("_concept"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in SYSTEMS.values()]
    )
    coded = F.lower(F.col(kind)).isin("observation", "condition")
    joined = df.join(terms, coded & (F.lower(F.col("concept")) == key), "left").drop("_concept")
    observed = F.lower(F.col(kind)) == "observation"
    return joined.withColumn("loinc", F.when(observed, F.col("loinc")))


def codes_map(df: DataFrame) -> Column:
    """The attached codes as one map without empty entries."""
    pairs = [part for system, name in SYSTEMS.items() for part in (F.lit(system), F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, code: code.isNotNull())


def map_codes(df: DataFrame, catalog: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Codes in the target systems that share a concept with each (system, code) row."""
    long = catalog.unpivot("concept", list(SYSTEMS.values()), "_system", "_code").filter(F.col("_code") != "")
    source = long.select("concept", F.col("_system").alias("system"), F.col("_code").alias("code"))
    target = long.filter(F.col("_system").isin([t.lower() for t in targets])).select(
        "concept", F.col("_system").alias("target_system"), F.col("_code").alias("target_code")
    )
    known = df.withColumn("system", F.lower("system")).join(source, ["system", "code"])
    return known.join(target, "concept").filter(F.col("system") != F.col("target_system"))


def normalize(
    df: DataFrame,
    catalog: DataFrame,
    allowed: Sequence[str] = SUPPORTED,
    received_at: str = "received_at",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Canonical records with codes; rejected rows have only ``id``, ``reason`` and the columns to keep.

    One projection covers all resource types, so the payload is read once.
    """
    routed = route_resources(df, allowed)
    by_type = {
        "observation": observation_fields(),
        "condition": condition_fields(),
        "procedure": procedure_fields(),
    }
    accepted = F.col("reason").isNull()
    names = dict.fromkeys(name for fields in by_type.values() for name in fields)

    def merged(name: str) -> Column:
        value = F.lit(None).cast("string")
        for key, fields in by_type.items():
            if name in fields:
                value = F.when(F.col("resource_key") == key, fields[name]).otherwise(value)
        return F.when(accepted, value)

    columns = {
        "patient_id": F.when(accepted, patient_ref()),
        "resource_type": F.when(accepted, title_case("resource_key")),
        **{name: merged(name) for name in names},
        "timestamp": F.when(accepted, event_time("payload", F.col(received_at))),
    }
    held = df.schema["payload"].dataType.names
    if "tenant_id" in held:
        columns["tenant_id"] = F.when(accepted, F.coalesce(present("payload.tenant_id"), F.lit(PUBLIC)))
    if "mrn" in held:
        columns["mrn"] = F.when(accepted, present("payload.mrn"))
    records = evaluate_once(routed.select("id", "payload", "resource_key", received_at, "reason", *keep), columns)
    return attach_codes(records.select("id", *columns, "reason", *keep), catalog)
