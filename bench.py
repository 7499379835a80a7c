"""Times the registered plans on the tables of one scale factor and prints one JSON line.

BENCH_SF_DIR   data folder, default /root/testdata/sf0.1
BENCH_CPUS     threads, default 8
BENCH_QUERIES  comma-separated plan names, default all

Beside the plans it times plain hand-written Spark SQL for the results of some of them
(``yardstick``), since there is no published number to compare with.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vitalweave.plans import PLANS
from vitalweave.session import build_session
from vitalweave.sources import fixtures
from vitalweave.sources.reference_data import CLINICAL_RULES

GLUCOSE = "resource_type = 'Observation' AND concept = 'blood-glucose' AND value >= 100"
MASKED = "text"
for _rule in CLINICAL_RULES:
    # A backslash stands twice in a literal, a brace twice in a statement with names.
    _pattern = _rule.pattern.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    MASKED = f"regexp_replace({MASKED}, '{_pattern}', '{_rule.mask}')"
NEWEST = "row_number() OVER (PARTITION BY {0} ORDER BY {1})"
YARDSTICK = {
    "c3_cohort_count": f"SELECT count(DISTINCT patient_id) FROM {{facts}} WHERE {GLUCOSE}",
    "c10_timeline": f"""SELECT id, patient_id, concept, timestamp FROM (
        SELECT *, {NEWEST.format('patient_id', 'timestamp, id')} AS n FROM {{facts}}) WHERE n <= 20""",
    "c12_materialize_cohort": f"""SELECT patient_id, count(*), avg(value), max_by(concept, struct(timestamp, id)),
        max_by(value, struct(timestamp, id)), max(timestamp) FROM {{facts}} WHERE {GLUCOSE} GROUP BY patient_id""",
    "c13_evaluate_cohorts": f"""SELECT DISTINCT 'a', patient_id FROM {{facts}} WHERE {GLUCOSE}
        UNION ALL SELECT DISTINCT 'b', patient_id FROM {{facts}} WHERE concept IN ('heart-rate', 'blood-pressure') AND value < 200
        UNION ALL SELECT DISTINCT 'c', patient_id FROM {{facts}} WHERE code_snomed = '44054006'
        UNION ALL SELECT DISTINCT 'd', patient_id FROM {{facts}} WHERE concept = 'heart-rate' AND value > 100
        UNION ALL SELECT DISTINCT 'e', patient_id FROM {{facts}} WHERE master_id >= 'master-5' AND resource_type <> 'Procedure'""",
    "e6_audit_tail": f"""SELECT * FROM (SELECT *, {NEWEST.format('study_id', 'created_at DESC, id DESC')} AS n FROM {{audit_events}}
        WHERE study_id IS NOT NULL) WHERE n <= 50""",
    "f5_latest_features": f"""SELECT * FROM (SELECT *, {NEWEST.format('entity_id', 'created_at DESC, version DESC')} AS n
        FROM {{offline_features}}) WHERE n = 1""",
    "l3_link_probabilistic": f"""SELECT * FROM (SELECT *, {NEWEST.format('inc_id', 'score, reg_id')} AS n FROM (
        SELECT i.inc_id, r.reg_id, levenshtein(r.patient_id, trim(i.patient_id)) AS score
        FROM {{incoming}} i JOIN {{registry}} r ON r.block = i.block)) WHERE n = 1""",
    "m3_request_summary": """SELECT count_if(status = 'accepted'), count_if(status = 'published'), count_if(status <> 'published') FROM {requests}""",
    "p6_mask_documents": f"SELECT doc_id, {MASKED} AS text FROM {{documents}}",
    "v2_latest_status": f"""SELECT * FROM (SELECT *, {NEWEST.format('id', 'at DESC, seq DESC')} AS n FROM {{status_events}}) WHERE n = 1""",
}


def hand_written(spark, sf_dir: str, name: str):
    """The plain statement for a plan, over the same derived tables."""
    text = YARDSTICK[name]
    names = [t for t in [*fixtures.STATEMENTS, "documents"] if "{" + t + "}" in text]
    return spark.sql(text, **{t: fixtures.load(spark, sf_dir, t) for t in names})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(PLANS)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "1m",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    PLANS["c3_cohort_count"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    yardstick: dict[str, float] = {}

    def measure(into: dict[str, float], name: str, build) -> None:
        start = time.perf_counter()
        try:
            build().write.format("noop").mode("overwrite").save()
        except Exception as error:  # one failing plan must not hide the others
            print(f"{name}: {error}", file=sys.stderr)
            return
        into[name] = round(time.perf_counter() - start, 3)

    for name in names:
        measure(times, name, lambda: PLANS[name](spark, sf_dir))
    for name in names:
        if name in YARDSTICK:
            measure(yardstick, name, lambda: hand_written(spark, sf_dir, name))
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    result = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale, "yardstick": yardstick}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
