"""The online view as a stream: newest row, expiry by the event clock, restart, and the batch form."""

from datetime import timedelta

from pyspark.sql import functions as F

from vitalweave.operators.features import online_features
from vitalweave.streaming import online_features as O

SCHEMA = "entity_id string, version long, features map<string,string>, created_at timestamp_ntz, source_id string"
TTL = timedelta(minutes=5)


def rows_of(spark, values):
    df = spark.createDataFrame([(e, v, {"v": x}, s) for e, v, x, s in values], "entity_id string, version long, features map<string,string>, seconds long")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seconds"))
    return df.select("entity_id", "version", "features", at.alias("created_at"), F.col("seconds").cast("string").alias("source_id"))


BATCHES = [
    [("a", 1, "a1", 10), ("b", 1, "b1", 20), ("a", 2, "a2", 15)],
    [("a", 3, "late", 12), ("c", 1, "c1", 200), ("b", 2, "tie", 20)],
    [("d", 1, "d1", 900), ("c", 2, "c2", 640)],
    [("a", 9, "again", 1000), ("e", 1, "e1", 1000)],
]


def test_stream_is_the_batch_form_after_each_start(spark, tmp_path):
    topic, out, checkpoint = (str(tmp_path / x) for x in ("topic", "out", "checkpoint"))
    for n, values in enumerate(BATCHES):
        rows_of(spark, values).coalesce(1).write.mode("append").parquet(topic)
        stream = spark.readStream.schema(SCHEMA).parquet(topic)
        O.run_online(stream, out, checkpoint, TTL).awaitTermination()
        seen = [v for part in BATCHES[: n + 1] for v in part]
        as_of = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(max(v[3] for v in seen)))
        want = online_features(rows_of(spark, seen), as_of, TTL)
        found = O.read_online(spark, out, as_of, TTL)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))
    # By the clock of the last batches, the rows of the first ones have ended.
    assert not {"b"} & {r.entity_id for r in O.entities_held(spark, out).collect()}
    assert spark.read.parquet(out).filter("NOT alive").count() > 0
