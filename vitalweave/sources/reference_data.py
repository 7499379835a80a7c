"""Privacy rules and the terminology catalog: small configuration with built-in defaults."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``needs`` is text every match contains; it lets a scan skip quickly."""

    name: str
    type: str
    pattern: str
    mask: str
    severity: str = "medium"
    enabled: bool = True
    needs: str = ""


# Rules used when no configuration is given.
DEFAULT_RULES = (
    Rule("SSN", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****", "high", True, "-"),
    Rule("DOB", "dob", r"\b\d{1,2}/\d{1,2}/\d{4}\b", "##/##/####", "medium", True, "/"),
    Rule("Email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "***@***", "medium", True, "@"),
    Rule(
        "Phone", "phone", r"\b\d{3}-\d{3}-\d{4}\b|\b\(\d{3}\)\s?\d{3}-\d{4}\b", "(***) ***-****", "medium", True, "-"
    ),
)
# The clinical rule set, which adds medical record numbers.
CLINICAL_RULES = DEFAULT_RULES + (
    Rule("Medical Record Number", "mrn", r"MRN\s*[:#]?\s*[A-Z0-9-]{6,}", "MRN-******", "high", True, "MRN"),
)


@dataclass(frozen=True)
class Concept:
    concept: str
    display: str
    snomed: str
    loinc: str
    icd10: str


# Concepts used when no catalog is given.
DEFAULT_CONCEPTS = (
    Concept("blood-glucose", "Blood Glucose", "271062007", "2339-0", "R73.9"),
    Concept("blood-pressure", "Blood Pressure", "75367002", "85354-9", "I10"),
)
# The full clinical catalog.
CLINICAL_CONCEPTS = DEFAULT_CONCEPTS + (
    Concept("heart-rate", "Heart rate", "364075005", "8867-4", "R00.8"),
    Concept("diagnosis-diabetes", "Type 2 diabetes mellitus", "44054006", "", "E11.9"),
)

RULE_SCHEMA = "name string, type string, pattern string, mask string, severity string, enabled boolean, needs string"
CATALOG_SCHEMA = "concept string, display string, snomed string, loinc string, icd10 string"


def _rows(kind: type, given: Iterable[object] | None, default: tuple, what: str) -> list:
    if given is None:
        return list(default)
    rows = [kind(**item) if isinstance(item, Mapping) else item for item in given]
    if not rows:
        raise ValueError(f"no {what} configured")
    return rows


def _local_table(spark: SparkSession, rows: list) -> DataFrame:
    """Rows as a local relation: unlike a parallelized list, its size is known when a join is planned."""
    return spark.createDataFrame(pa.Table.from_pylist([asdict(row) for row in rows]))


def rules(given: Iterable[Rule | Mapping] | None = None) -> list[Rule]:
    """Enabled rules in order; defaults when none are given, an error when the list is empty."""
    return [r for r in _rows(Rule, given, DEFAULT_RULES, "privacy rules") if r.enabled]


def rules_df(spark: SparkSession, given: Iterable[Rule | Mapping] | None = None) -> DataFrame:
    found = _rows(Rule, given, DEFAULT_RULES, "privacy rules")
    return _local_table(spark, found)


def _yaml(spark: SparkSession, path: str) -> dict:
    """A YAML configuration file from any file system that Spark reads."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("PyYAML is needed for YAML files; use JSON instead") from error
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def _known_fields(kind: type, item: Mapping) -> dict:
    return {k: v for k, v in item.items() if k in kind.__dataclass_fields__}


def read_rules(spark: SparkSession, path: str, limit: int = MAX_RULES) -> list[Rule]:
    """Rules from a JSON or YAML file. They become literals of the plan, hence the checked row count."""
    if path.endswith((".yaml", ".yml")):
        return rules(_known_fields(Rule, item) for item in _yaml(spark, path).get("rules") or [])
    found = spark.read.schema(RULE_SCHEMA).json(path).na.fill({"needs": "", "enabled": True}).take(limit + 1)
    if len(found) > limit:
        raise ValueError(f"more than {limit} privacy rules in {path}")
    return rules(r.asDict() for r in found)


def catalog_df(spark: SparkSession, given: Iterable[Concept | Mapping] | None = None) -> DataFrame:
    """The catalog as a local table; of concepts that differ in case only, the first one counts."""
    found = _rows(Concept, given, DEFAULT_CONCEPTS, "terminology concepts")
    first = {c.concept.lower(): c for c in reversed(found)}
    return _local_table(spark, [c for c in found if first[c.concept.lower()] is c])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Terminology rows from JSON, or from YAML with the concepts as keys."""
    if path.endswith((".yaml", ".yml")):
        concepts = _yaml(spark, path).get("concepts") or {}
        empty = {"display": "", "snomed": "", "loinc": "", "icd10": ""}
        return catalog_df(spark, [{**empty, **_known_fields(Concept, c), "concept": k} for k, c in concepts.items()])
    rows = spark.read.schema(CATALOG_SCHEMA).json(path).na.fill("")
    # A concept joins in lower case, so it may be there only once in that form.
    one = F.min_by(F.struct(*rows.columns), F.struct(*rows.columns))
    found = rows.groupBy(F.lower("concept").alias("_key")).agg(one.alias("_row")).select("_row.*")
    if not found.take(1):
        raise ValueError("terminology catalog empty")
    return found
