"""From event messages to facts, rollups, features, links and vault, in one streaming query.

The stages between message and record are row-local, so they run in the same tasks
that read the source. Masters are hashes of their key, so a batch needs no state
from earlier batches and writes the same rows when it is replayed. Records without a key can
be linked by similarity; then a batch reads the index that earlier batches have left.

Rejected messages go to the quarantine by id and, whole, to the dead letters, which hold raw
data and belong under the same lock as the vault. Mended letters pass through the flow again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalweave.functions.once import evaluate_once
from vitalweave.functions.scalars import present, rfc3339_time
from vitalweave.operators.cohort import rollup_rows
from vitalweave.operators.features import append_features, event_features
from vitalweave.operators.ingest import validate_requests
from vitalweave.operators.linkage import THRESHOLD, deterministic_key, known_masters, link_known, link_rows, master_id
from vitalweave.operators.match_index import MatchIndex
from vitalweave.operators.normalize import PAYLOAD, SUPPORTED, normalize
from vitalweave.operators.privacy import hidden_texts, matches, phi_confidence, tokenize, vault_entries
from vitalweave.session import cut_lineage
from vitalweave.sources.events import read_events
from vitalweave.sources.fact_table import FactTable, exists
from vitalweave.sources.reference_data import CLINICAL_RULES, Rule
from vitalweave.streaming.feature_store import KeyedFeatures

REQUEST = "source string, format string, data string, patient_id string, received_at string"
TABLES = ("facts", "rollups", "features", "links", "vault", "quarantine", "dead_letters", "requests", "phi")
#: Batches of a replay are numbered apart from those of the first run.
LANE = 10**9


@dataclass(frozen=True)
class Similar:
    """Linking of records without a key: the folder of a :class:`MatchIndex` of (block, text, master), and the record's columns."""

    path: str
    block: str = "tenant_id"
    text: str = "patient_id"
    threshold: float = THRESHOLD


def unwrap(events: DataFrame) -> DataFrame:
    """Decoded events to validated requests: the resource leaves its request wrapper once, here."""
    extra = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("raw", "position")]
    opened = evaluate_once(events, {"_request": F.from_json("data", REQUEST)}).select(
        "id",
        *extra,
        F.col("_request.source").alias("source"),
        F.col("_request.format").alias("format"),
        F.col("_request.data").alias("data"),
        F.col("_request.patient_id").alias("request_patient"),
        F.coalesce(rfc3339_time("_request.received_at"), rfc3339_time("timestamp")).alias("received_at"),
        F.col("reason").alias("_malformed"),
    )
    stage = F.when(F.col("_malformed").isNotNull(), "decode").when(F.col("reason").isNotNull(), "validate")
    checked = validate_requests(opened).withColumns({"stage": stage, "reason": F.coalesce("_malformed", "reason")})
    parsed = evaluate_once(checked, {"_payload": F.when(F.col("reason").isNull(), F.from_json("data", PAYLOAD))})
    owner = F.coalesce(present("_payload.patient_id"), present("request_patient"))
    filled = evaluate_once(parsed, {"payload": F.col("_payload").withField("patient_id", owner)})
    return filled.drop("_payload", "_malformed", "request_patient")


def prepare(
    events: DataFrame,
    catalog: DataFrame,
    salt: str,
    rules: Sequence[Rule] = CLINICAL_RULES,
    allowed: Sequence[str] = SUPPORTED,
) -> DataFrame:
    """Decoded events to de-identified canonical records, on a batch or a stream.

    ``reason`` and ``stage`` are set for rejected events, ``raw`` is the message of those. ``hidden`` holds
    the texts that became tokens; it goes to the vault and to no other table.
    """
    requests = unwrap(events)
    matched = evaluate_once(requests, {"_matches": matches(requests, ["payload"], rules)})
    found = evaluate_once(
        matched,
        {
            "phi": F.array_distinct(F.col("_matches.value")),
            "phi_types": F.array_sort(F.array_distinct(F.col("_matches.type"))),
            "phi_count": F.size("_matches"),
        },
    ).drop("_matches")
    hidden = hidden_texts(found, ["payload"], F.col("phi"))
    marked = found.withColumns({"hidden": hidden, "rejected": F.col("reason"), "arrived_at": F.col("received_at")})
    kept = ("hidden", "rejected", "stage", "raw", "position", "source", "format", "arrived_at", "phi_types", "phi_count")
    records = normalize(tokenize(marked, ["payload"], salt, rules, values="phi"), catalog, allowed, keep=kept)
    reason = F.coalesce("rejected", "reason")
    refused = reason.isNotNull()
    ended = {
        "stage": F.when(refused, F.coalesce("stage", F.lit("normalize"))),
        "raw": F.when(refused, F.col("raw")),
        "reason": reason,
    }
    return records.withColumns(ended).drop("rejected")


def _linked(keyed: DataFrame, batch_id: int, similar: Similar | None) -> DataFrame:
    """Records with the master, score and method of their key, else of the most similar known text, else of a new entity."""
    fresh = F.col("link_key").isNull()
    if similar is None:
        return keyed.withColumns(
            {
                "master_id": F.when(fresh, master_id(F.col("id"))).otherwise(F.col("master_id")),
                "score": F.lit(1.0),
                "method": F.when(fresh, F.lit("new")).otherwise(F.col("method")),
            }
        )
    asks = fresh & F.col("reason").isNull()
    rows = keyed.withColumns({"_block": F.when(asks, F.col(similar.block)), "_text": F.when(asks, present(similar.text))})
    texts = rows.filter("_text IS NOT NULL").select(F.col("_block").alias("block"), F.col("_text").alias("text")).distinct()
    texts = cut_lineage(texts.na.drop())
    index = MatchIndex(keyed.sparkSession, similar.path, before=batch_id)
    best = index.match(texts, similar.threshold)
    # Equal texts of a block that nothing is like are one new entity, also for the batches to come.
    new = texts.join(best.select("block", "text"), ["block", "text"], "left_anti")
    index.add(new.withColumn("ref", master_id(F.concat_ws("|", "block", "text"))), batch_id)
    known = best.select(F.col("block").alias("_block"), F.col("text").alias("_text"), F.col("ref").alias("_ref"), F.col("score").alias("_score"))
    joined = rows.join(known, ["_block", "_text"], "left")
    made = F.coalesce("_ref", F.when(F.col("_block").isNotNull() & F.col("_text").isNotNull(), master_id(F.concat_ws("|", "_block", "_text"))), master_id(F.col("id")))
    how = F.when(F.col("_ref").isNotNull(), F.lit("probabilistic")).otherwise(F.lit("new"))
    return joined.withColumns(
        {
            "master_id": F.when(fresh, made).otherwise(F.col("master_id")),
            "score": F.coalesce("_score", F.lit(1.0)),
            "method": F.when(fresh, how).otherwise(F.col("method")),
        }
    ).select(*keyed.columns)


def store_batch(
    records: DataFrame,
    batch_id: int,
    out: str,
    salt: str,
    known: DataFrame,
    link_fields: Sequence[str] = ("patient_id",),
    similar: Similar | None = None,
    entity: str = "master_id",
    keyed_features: bool = False,
) -> None:
    """Link prepared records and write every table of the batch under its id; a replay overwrites the same folders.

    ``known`` has one master for each key, see :func:`known_masters`. With ``similar``, records without a
    key get the master of the most similar known text. ``entity`` names the features' entity. With
    ``keyed_features`` a feature version that an earlier batch has stored stays; else the one with the smallest
    source id of all batches is read.
    """
    spark = records.sparkSession
    keyed = link_known(deterministic_key(records, link_fields), known)
    if similar is not None:
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    linked = _linked(keyed, batch_id, similar).persist(StorageLevel.MEMORY_AND_DISK)
    accepted = linked.filter(F.col("reason").isNull())
    facts = accepted.select(
        "id", "master_id", "patient_id", "resource_type", "concept", "value", "unit", "timestamp",
        F.col("loinc").alias("code_loinc"), F.col("snomed").alias("code_snomed"), F.col("icd10").alias("code_icd10"), "tenant_id",
    )
    attributes = ["concept", "value", "unit", "recorded_date", "clinical_status", "performed"]
    refused = linked.filter(F.col("reason").isNotNull())
    features = event_features(facts, entity)
    tables = {
        "rollups": rollup_rows(facts),
        "links": link_rows(accepted, attributes),
        "vault": vault_entries(linked.select(F.explode("hidden").alias("value")), salt),
        "quarantine": refused.select("id", "reason", "stage"),
        "dead_letters": refused.select(F.sha2("raw", 256).alias("letter_id"), "id", "stage", "reason", "raw", "position", "arrived_at"),
        "requests": _request_rows(linked),
        "phi": _phi_rows(linked),
    }
    if not keyed_features:
        tables["features"] = append_features(features)
    try:
        FactTable(spark, f"{out}/facts").append(facts, batch_id)
        if keyed_features:
            KeyedFeatures(spark, f"{out}/features").append(features, batch_id)
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
    finally:
        linked.unpersist()
        keyed.unpersist()


def _request_rows(records: DataFrame) -> DataFrame:
    """The state in which the flow leaves each decoded request, as rows for the operational reports."""
    status = F.when(F.col("reason").isNull(), "published").otherwise("failed")
    return records.filter(F.col("id").isNotNull()).select(
        "id", "source", "format", status.alias("status"), F.col("reason").alias("error"), F.lit(0).alias("retry_count"),
        F.col("arrived_at").alias("created_at"), F.col("arrived_at").alias("updated_at"),
    )


def _phi_rows(records: DataFrame) -> DataFrame:
    """What health information each request that passed validation held: counts and kinds, no values."""
    seen = records.filter(F.coalesce("stage", F.lit("")).isin("", "normalize"))
    count = F.col("phi_count")
    return seen.select("id", (count > 0).alias("detected"), count.alias("match_count"), phi_confidence(count).alias("confidence"), "phi_types")


def run_flow(
    events: DataFrame,
    out: str,
    checkpoint: str,
    catalog: DataFrame,
    salt: str,
    links: DataFrame,
    delay: str | None = None,
    link_fields: Sequence[str] = ("patient_id",),
    similar: Similar | None = None,
    entity: str = "master_id",
    keyed_features: bool = False,
    lane: int = 0,
    **options: object,
) -> StreamingQuery:
    """Start the stream over decoded events; it stops by itself when the available input is stored.

    The stages up to the canonical record belong to the streaming plan, which is built
    once; a batch only links and writes. Messages are dealt evenly to tasks first. With a ``delay``, an event id that comes again
    within it is stored once. The links known at the start are reduced to one master for
    each key before the first batch. ``lane`` keeps the batches of another run into the same
    tables apart; ``similar``, ``entity`` and ``keyed_features`` are those of :func:`store_batch`.
    """
    known = cut_lineage(known_masters(links))

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, lane * LANE + batch_id, out, salt, known, link_fields, similar, entity, keyed_features)

    if delay:
        timed = events.withColumn("sent_at", rfc3339_time("timestamp").cast("timestamp"))
        events = dedupe_events(timed, delay, "sent_at")
    else:
        # Parsing and masking are the work here, not the bytes: a source of few splits would keep them in few tasks.
        events = events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        prepare(events, catalog, salt, **options)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def mend_letters(spark: SparkSession, out: str, mend: Callable[[DataFrame], Column]) -> None:
    """Write the open dead letters for which ``mend`` gives a message to the folder that a replay reads.

    A letter is mended once: those that have been are left out.
    """
    letters = open_letters(spark, out)
    mended = letters.withColumn("value", mend(letters)).filter(F.col("value").isNotNull()).select("letter_id", "value")
    cut_lineage(mended).write.mode("append").parquet(f"{out}/mended")


def open_letters(spark: SparkSession, out: str) -> DataFrame:
    """Dead letters that have not been mended, each once."""
    letters = spark.read.parquet(f"{out}/dead_letters").drop("batch_id").dropDuplicates(["letter_id"])
    if not exists(spark, f"{out}/mended"):
        return letters
    return letters.join(spark.read.parquet(f"{out}/mended").select("letter_id"), "letter_id", "left_anti")


def replay_letters(spark: SparkSession, out: str, checkpoint: str, catalog: DataFrame, salt: str, links: DataFrame, **options: object) -> StreamingQuery:
    """Pass mended letters through the flow into the same tables. With its checkpoint, each is read exactly once."""
    mended = read_events(spark, "parquet", {"path": f"{out}/mended"})
    return run_flow(mended, out, checkpoint, catalog, salt, links, lane=1, **options)


def read_store(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A stored table over all batches: each vault entry once, and the first write of each feature version."""
    rows = spark.read.parquet(f"{out}/{table}")
    if table == "vault":
        return rows.drop("batch_id").dropDuplicates(["token"])
    return append_features(rows) if table == "features" else rows


def dedupe_events(df: DataFrame, delay: str = "1 hour", at: str = "timestamp") -> DataFrame:
    """Each event id once. A stream forgets ids older than ``delay``."""
    if df.isStreaming:
        return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(["id"])
    return df.dropDuplicates(["id"])


def minute_rates(df: DataFrame, status: Column, at: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """Events per minute and status."""
    timed = df.withColumn("_status", status)
    if df.isStreaming:
        timed = timed.withWatermark(at, delay)
    counts = timed.groupBy(F.window(at, "1 minute").alias("_window"), "_status").agg(F.count("*").alias("events"))
    return counts.select(F.col("_window.start").alias("minute"), F.col("_status").alias("status"), "events")


def store_updates(df: DataFrame, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Store the changed rows of an aggregating stream under their batch id."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
