"""Clinical studies: summaries, form versions, consents, audit trail and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import latest_per_key, running_total, top_n_per_key

# Statuses that count as taking part, defaults of new rows, list sizes.
ACTIVE_SUBJECTS = ("enrolled", "active", "randomized")
ACTIVE_STUDIES = ("active", "enrolling")
DEFAULTS = {
    "studies": {"status": "draft"},
    "study_sites": {"status": "planned"},
    "study_forms": {"status": "draft"},
    "visit_templates": {"required": True},
    "subjects": {"status": "screening"},
}
LIST_ROWS = 50


def _size(n: int) -> int:
    """A list size as it is given; one below 1 is an error."""
    if n < 1:
        raise ValueError("the size of a list must be at least 1")
    return n


def study_summary(
    studies: DataFrame, sites: DataFrame, forms: DataFrame, visits: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Each study with its number of sites, forms, form slugs, visits, and active and total subjects.

    Every child table is reduced to one row per study before it is joined.
    """
    active = F.count_if(F.col("status").isin(*ACTIVE_SUBJECTS))
    children = [
        sites.groupBy("study_id").agg(F.count("*").alias("site_count")),
        forms.groupBy("study_id").agg(
            F.count("*").alias("form_count"), F.count_distinct("slug").alias("form_slugs")
        ),
        visits.groupBy("study_id").agg(
            F.count("*").alias("visit_count"), F.count_if("required").alias("required_visits")
        ),
        subjects.groupBy("study_id").agg(active.alias("active_subjects"), F.count("*").alias("total_subjects")),
    ]
    summary = studies
    counts = []
    for child in children:
        counts += [c for c in child.columns if c != "study_id"]
        summary = summary.join(child, "study_id", "left")
    return summary.na.fill(0, counts)


def study_forms(forms: DataFrame) -> DataFrame:
    """Forms of a study together, in the order they are listed: by slug, newest version first."""
    return forms.repartition("study_id").sortWithinPartitions("study_id", "slug", F.desc("version"))


def study_visits(visits: DataFrame) -> DataFrame:
    """Visits of a study together, in their order."""
    return visits.repartition("study_id").sortWithinPartitions("study_id", "visit_order", "visit_id")


def recent_studies(df: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("study_id")).limit(_size(n))


def assign_form_versions(
    submissions: DataFrame, existing: DataFrame | None = None, bucket: Column | None = None
) -> DataFrame:
    """Version of each submitted form: one more than the latest for its (study, slug), in submission order.

    Positions are counted per bucket of submissions and carried forward, so a slug
    with very many submissions is not sorted in a single task.
    """
    step = bucket if bucket is not None else F.floor(F.col("submitted_seq") / F.lit(100_000))
    numbered = running_total(
        submissions, ["study_id", "slug"], [F.asc("submitted_seq")], F.lit(1).cast("bigint"), step, "version"
    )
    if existing is not None:
        latest = existing.groupBy("study_id", "slug").agg(F.max("version").alias("_latest"))
        numbered = numbered.join(latest, ["study_id", "slug"], "left")
        numbered = numbered.withColumn("version", F.col("version") + F.coalesce("_latest", F.lit(0))).drop("_latest")
    if "status" in numbered.columns:
        return numbered.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")))
    return numbered.withColumn("status", F.lit("draft"))


def apply_consents(subjects: DataFrame, signatures: DataFrame) -> DataFrame:
    """Subjects with a signature become enrolled, consented at the time given in the last one recorded.

    Others keep their status and the consent time they have.
    """
    last = signatures.groupBy("subject_id").agg(
        F.max_by("signed_at", F.struct("recorded_at", "signature_id")).alias("_signed_at")
    )
    signed = F.col("_signed_at").isNotNull()
    joined = subjects.join(last, "subject_id", "left")
    return joined.withColumns(
        {
            "status": F.when(signed, F.lit("enrolled")).otherwise(F.col("status")),
            "consented_at": F.coalesce("_signed_at", "consented_at") if "consented_at" in subjects.columns else F.col("_signed_at"),
        }
    ).drop("_signed_at")


def list_consent_versions(df: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    """Newest consent versions of each study by effective time."""
    order = [F.desc("effective_at"), F.desc("id")]
    return top_n_per_key(df, ["study_id"], order, _size(n))


def list_subjects(df: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    """Newest subjects of each study."""
    order = [F.desc("created_at"), F.desc("subject_id")]
    return top_n_per_key(df, ["study_id"], order, _size(n))


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit entries: a blank actor is the system, entries without a study are left out."""
    actor = F.coalesce(F.nullif("actor", F.lit("")), F.lit("system"))
    return events.filter(F.col("study_id").isNotNull()).withColumn("actor", actor)


def audit_tail(log: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    order = [F.desc("created_at"), F.desc("id")]
    return top_n_per_key(log, ["study_id"], order, _size(n))


def current_study_status(events: DataFrame) -> DataFrame:
    """Status of each study after its last change (study_id, status, at, seq)."""
    return latest_per_key(events.select("study_id", "status", "at", "seq"), ["study_id"], ["at", "seq"])


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """New rows with the default of the table where a value is missing."""
    changed = {}
    for name, default in DEFAULTS[table].items():
        given = F.col(name) if name in df.columns else F.lit(None)
        if isinstance(default, str):
            given = F.nullif(given.cast("string"), F.lit(""))
        changed[name] = F.coalesce(given, F.lit(default))
    return df.withColumns(changed)


def portfolio(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count("*").alias("studies"),
        F.count_if(F.col("status").isin(*ACTIVE_STUDIES)).alias("active_studies"),
        F.coalesce(F.sum("total_subjects"), F.lit(0)).alias("total_subjects"),
        F.coalesce(F.sum("active_subjects"), F.lit(0)).alias("active_subjects"),
    )


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; keys with a null are exempt, as in a unique constraint."""
    return df.na.drop(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but names no parent."""
    known = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti")
