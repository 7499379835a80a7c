import pytest
from pyspark.sql import functions as F

from vitalweave.operators.linkage import known_masters
from vitalweave.operators.match_index import MatchIndex
from vitalweave.plans.registry import Tables
from vitalweave.plans.streams import messages, run_clinical
from vitalweave.session import cut_lineage, shared_dir
from vitalweave.sources.events import decode_events, read_events, write_events
from vitalweave.sources.reference_data import CLINICAL_CONCEPTS, catalog_df
from vitalweave.streaming import flow

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


def stored(spark, out):
    names = {}
    for name in flow.TABLES:
        rows = flow.read_store(spark, out, name)
        names[name] = sorted(str(r) for r in rows.drop("batch_id").collect())
    return names


def test_stream_equals_batch_and_replay_changes_nothing(spark, tables, tmp_path):
    folder, catalog = str(tmp_path / "topic"), catalog_df(spark, CLINICAL_CONCEPTS)
    links = tables["links"].limit(0)
    known = known_masters(links)
    sent = messages(tables["payloads"])
    for part in range(3):
        write_events(sent.filter(F.col("key").cast("int") % 3 == part), folder)
    stream = read_events(spark, "parquet", {"path": folder, "maxFilesPerTrigger": "1"})
    out = str(tmp_path / "stream")
    flow.run_flow(stream, out, str(tmp_path / "checkpoint"), catalog, "salt", links).awaitTermination()
    assert len(list((tmp_path / "stream" / "facts").glob("batch_id=*"))) >= 3
    batch = flow.prepare(decode_events(sent), catalog, "salt")
    once = str(tmp_path / "batch")
    flow.store_batch(batch, 0, once, "salt", known)
    assert stored(spark, out) == stored(spark, once)
    flow.store_batch(batch, 0, once, "salt", known)
    assert stored(spark, out) == stored(spark, once)


def test_registered_flow_reuses_known_masters(spark):
    class Known(Tables):
        def __getitem__(self, name):
            rows = super().__getitem__(name)
            if name != "links":
                return rows
            known = rows.limit(1).withColumn("master_id", F.lit("m-known")).withColumn("deterministic_key", F.lit("patient_id:patient-000008"))
            return rows.unionByName(known)

    facts = flow.read_store(spark, run_clinical(Known(spark, SF_DIR)), "facts")
    found = {(r.patient_id == "patient-000008", r.master_id == "m-known") for r in facts.select("patient_id", "master_id").distinct().collect()}
    assert found == {(True, True), (False, False)}


def test_events_sent_twice_are_stored_once(spark, tables, tmp_path):
    folder = str(tmp_path / "topic")
    for _ in range(2):
        write_events(messages(tables["payloads"]), folder)
    stream = read_events(spark, "parquet", {"path": folder, "maxFilesPerTrigger": "1"})
    out, catalog = str(tmp_path / "out"), catalog_df(spark, CLINICAL_CONCEPTS)
    links = spark.sql("SELECT 1L id, 'm-known' master_id, 'patient_id:patient-000008' deterministic_key, TIMESTAMP_NTZ'2024-01-01' created_at")
    flow.run_flow(stream, out, str(tmp_path / "checkpoint"), catalog, "salt", links, delay="60 days").awaitTermination()
    facts = flow.read_store(spark, out, "facts")
    ids = facts.agg(F.count("*"), F.count_distinct("id")).first()
    assert ids[0] == ids[1] > 0
    known = facts.filter("patient_id = 'patient-000008'").select("master_id").distinct().collect()
    assert [r["master_id"] for r in known] == ["m-known"]


def test_health_information_never_reaches_the_facts(spark, tables, tmp_path):
    dirty = tables["payloads"].limit(40).withColumn(
        "payload_text", F.regexp_replace("payload_text", '"unit":"[^"]*"', '"unit":"call 555-123-4567"')
    )
    out = str(tmp_path / "out")
    batch = flow.prepare(decode_events(messages(dirty)), catalog_df(spark), "salt")
    flow.store_batch(batch, 0, out, "salt", known_masters(tables["links"].limit(0)))
    facts = flow.read_store(spark, out, "facts")
    assert facts.filter(F.col("unit").startswith("token_")).count() > 0
    assert facts.filter(F.col("unit").contains("555-123-4567")).count() == 0
    assert [r["value"] for r in flow.read_store(spark, out, "vault").collect()] == ["call 555-123-4567"]


def test_malformed_messages_go_to_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("{broken",), ('{"id":"1"}',), (None,)], "value string")
    assert [r["reason"] for r in decode_events(rows).collect()] == ["malformed event"] * 3


def test_message_form(tables):
    row = messages(tables["payloads"]).first()
    assert [h["key"] for h in row["headers"]] == ["event-type", "source"]
    assert bytes(row["headers"][0]["value"]) == b"upstream"


def test_stream_forgets_duplicates_in_its_delay(spark, tmp_path):
    folder = str(tmp_path / "in")
    for _ in range(2):
        spark.sql("SELECT id, TIMESTAMP'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp FROM range(20)").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id long, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    query = flow.dedupe_events(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert flow.dedupe_events(spark.read.parquet(folder)).count() == 20


def test_lineage_is_cut_in_the_shared_folder(spark):
    folder = shared_dir(spark)
    cut = cut_lineage(spark.range(10).withColumn("x", F.rand()))
    assert cut.count() == 10 and spark.conf.get("spark.checkpoint.dir") == folder
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().toString()


def test_similar_records_meet_known_and_earlier_masters(spark, tmp_path):
    registry = spark.createDataFrame([("t1", "pat-0001234-ab", "m-1"), ("t2", "pat-0001234-ab", "m-2"), ("t1", "pat-0009999-zz", "m-3")], "tenant string, name string, master string")
    index = str(tmp_path / "index")
    MatchIndex.build(registry, index, "tenant", "name", "master")

    def batch(rows):
        texts = [f'{{"resourceType":"Observation","tenant_id":"{tenant}","patient_id":"{name}"' + (f',"mrn":"{mrn}"' if mrn else "") + "}" for _, tenant, name, mrn in rows]
        df = spark.createDataFrame([(r[0], text) for r, text in zip(rows, texts)], "id long, payload_text string").withColumn("received_at", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
        return flow.prepare(decode_events(messages(df)), catalog_df(spark), "salt")

    known = known_masters(spark.sql("SELECT 1L id, 'm-key' master_id, 'mrn:r1' deterministic_key, TIMESTAMP_NTZ'2024-01-01' created_at"))
    out, similar = str(tmp_path / "out"), flow.Similar(index)
    first = batch([(1, "t1", "pat-0001243-ab", None), (2, "t2", "pat-0001243-ab", None), (3, "t3", "pat-0001243-ab", None), (4, "t1", "qqqq", None), (5, "t1", " qqqq ", None), (6, "t1", "", None), (7, "t1", "pat-0001243-ab", "R1"), (46, "t1", "pat-0001234-ab", None)])
    second = batch([(10, "t1", "qqqq", None), (11, "t1", "qqqqr", None), (12, "t2", "qqqq", None)])
    for rows, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        flow.store_batch(rows, number, out, "salt", known, ("mrn",), similar, "patient_id", True)
    found = {int(r.id): r.master_id for r in flow.read_store(spark, out, "facts").collect()}
    assert (found[1], found[2], found[7]) == ("m-1", "m-2", "m-key")
    assert found[3] not in ("m-1", "m-2") and found[4] == found[5] == found[10] == found[11]
    assert len({found[3], found[4], found[6], found[12]}) == 4
    links = {r.patient_id: (r.method, r.score) for r in flow.read_store(spark, out, "links").filter("patient_id LIKE 'qqqq_'").collect()}
    assert links["qqqqr"][0] == "probabilistic" and 0.85 <= links["qqqqr"][1] < 1
    # Message 46 came from an unknown source.
    letters = flow.open_letters(spark, out).collect()
    assert [(r.id, r.stage) for r in letters] == [("46", "validate")] and '"id":"46"' in letters[0].raw
    status = {r.id: r.status for r in flow.read_store(spark, out, "requests").collect()}
    assert status["46"] == "failed" and status["1"] == "published"
    assert len(flow.read_store(spark, out, "phi").collect()) == len(found)


def test_letters_are_mended_and_replayed_once(spark, tmp_path):
    catalog, links = catalog_df(spark), spark.createDataFrame([], "id long, master_id string, deterministic_key string, created_at timestamp_ntz")
    rows = spark.createDataFrame([(i, '{"resourceType":"Condition","patient_id":"p"}') for i in (1, 2, 23)], "id long, payload_text string").withColumn("received_at", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    sent = messages(rows)
    cut = sent.withColumn("value", F.when(F.col("key") == "2", F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    flow.store_batch(flow.prepare(decode_events(cut), catalog, "salt"), 0, out, "salt", known_masters(links))
    assert {r.stage for r in flow.open_letters(spark, out).collect()} == {"decode", "validate"}
    for _ in range(2):
        flow.mend_letters(spark, out, lambda letters: F.when(F.col("stage") == "decode", F.concat("raw", F.lit("}"))))
        flow.replay_letters(spark, out, checkpoint, catalog, "salt", links).awaitTermination()
        assert sorted(r.id for r in flow.read_store(spark, out, "facts").collect()) == ["1", "2"]
        assert [r.stage for r in flow.open_letters(spark, out).collect()] == ["validate"]


def test_messages_of_one_file_are_prepared_by_many_tasks(spark, tables, tmp_path, monkeypatch):
    folder = str(tmp_path / "topic")
    write_events(messages(tables["payloads"]).coalesce(1), folder)
    tasks = []
    monkeypatch.setattr(flow, "store_batch", lambda records, *rest: tasks.append(records.rdd.getNumPartitions()))
    stream = read_events(spark, "parquet", {"path": folder})
    flow.run_flow(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), catalog_df(spark, CLINICAL_CONCEPTS), "salt", tables["links"].limit(0)).awaitTermination()
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
