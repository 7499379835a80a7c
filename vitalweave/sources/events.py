"""Event envelopes: decoding from and encoding to topics or files, and the dead-letter split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.functions.once import evaluate_once

ENVELOPE = "id string, type string, source string, data string, timestamp string, metadata map<string,string>"


def decode_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns, the ``raw`` message and ``reason``, which is set for a message that does not decode.

    ``position`` is where a message from a topic stood, ``partition:offset``.
    """
    place = [F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("position")] if {"partition", "offset"} <= set(df.columns) else []
    text = df.select(F.col(value).cast("string").alias("raw"), *place)
    opened = evaluate_once(text, {"_event": F.from_json("raw", ENVELOPE)}).select("_event.*", "raw", *(["position"] if place else []))
    malformed = F.col("id").isNull() | F.col("data").isNull()
    return opened.withColumn("reason", F.when(malformed, F.lit("malformed event")))


def read_events(spark: SparkSession, source: str, options: Mapping[str, str]) -> DataFrame:
    """Stream of decoded events from ``kafka`` or a folder of Parquet or text files with a ``value`` column."""
    reader = spark.readStream.format(source).options(**options)
    if source == "parquet":
        reader = reader.schema("value string")
    return decode_events(reader.load())


def encode_events(df: DataFrame, payload: Column, kind: str, source: str) -> DataFrame:
    """Outgoing messages: key is the event id, headers carry type and source."""
    envelope = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.lit(kind).alias("type"),
            F.lit(source).alias("source"),
            payload.alias("data"),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        )
    )
    headers = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value"))
            for k, v in (("event-type", kind), ("source", source))
        ]
    )
    return df.select(F.col("id").cast("string").alias("key"), envelope.alias("value"), headers.alias("headers"))


def write_events(messages: DataFrame, target: str, kafka: Mapping[str, str] | None = None) -> None:
    """Publish a batch of encoded messages to a topic, or append them to a folder."""
    if kafka is not None:
        (
            messages.write.format("kafka")
            .options(**kafka)
            .option("topic", target)
            .option("includeHeaders", "true")
            .save()
        )
    else:
        messages.write.mode("append").parquet(target)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without ``reason``, and rejected rows with it."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())
