"""Feature versions in a keyed store whose first write of an (entity, version) stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.operators.features import append_features
from vitalweave.session import cut_lineage

BUCKETS = 64
KEY = ["entity_id", "version"]


class KeyedFeatures:
    """Feature rows below ``path``, by batch and by bucket of their entity.

    A batch reads the keys of the buckets that it touches, and of no others. It leaves out what
    other batches have stored and overwrites its own folder, so a replay writes the same
    rows again. One writer at a time, as a streaming query is.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _schema(self, rows: DataFrame) -> T.StructType:
        fields = [f for f in rows.schema.fields if f.name not in ("batch_id", "bucket")]
        return T.StructType([*fields, T.StructField("batch_id", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def append(self, rows: DataFrame, batch_id: int | str) -> None:
        """Store the first row of each (entity, version), by (created_at, source_id), that no other batch has stored."""
        first = append_features(rows).withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(self.buckets)).cast("int"))
        # A folder without rows, so that there is something to read before the first batch.
        first.limit(0).drop("bucket").write.mode("ignore").parquet(f"{self.path}/batch_id=none/bucket=-1")
        first = cut_lineage(first)
        touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]
        fresh = first.join(self.stored_keys(rows, touched, str(batch_id)), KEY, "left_anti")
        dealt = fresh.hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch_id={batch_id}")

    def stored_keys(self, rows: DataFrame, buckets: list[int], batch_id: str) -> DataFrame:
        """(entity_id, version) of the given buckets that batches other than ``batch_id`` have stored."""
        known = self.spark.read.schema(self._schema(rows)).parquet(self.path)
        return known.filter(F.col("bucket").isin(buckets) & (F.col("batch_id") != batch_id)).select(*KEY)

    def read(self) -> DataFrame:
        """All stored rows; each (entity_id, version) is there once."""
        return self.spark.read.parquet(self.path).drop("batch_id", "bucket")
