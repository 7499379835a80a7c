"""A fact table of streamed batches that is compacted behind its readers' backs.

Batches lie in ``batch_id=...`` folders. A compaction writes the rows of closed batches anew,
by type and day, and then a version that names the new folder and the batches in it. A
reader takes the newest complete version and the batches outside it, so the switch is the
moment when a version is complete; until then, and if the writer is lost, all see the old one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from vitalweave.sources.tables import write_facts

DONE = "_SUCCESS"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system that Spark reads; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(root) if f.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class FactTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, facts: DataFrame, batch_id: int | str) -> None:
        """Store a batch; a replay overwrites it."""
        write_facts(facts, f"{self.path}/batch_id={batch_id}", "overwrite")

    def batches(self) -> list[str]:
        """Ids of the complete batches."""
        found = [f.removeprefix("batch_id=") for f in folders(self.spark, self.path) if f.startswith("batch_id=")]
        return [b for b in found if exists(self.spark, f"{self.path}/batch_id={b}/{DONE}")]

    def version(self) -> tuple[int, list[str]]:
        """Number of the newest complete version and the batches that its folder holds; (0, []) before the first."""
        for name in reversed(folders(self.spark, f"{self.path}/_versions")):
            if exists(self.spark, f"{self.path}/_versions/{name}/{DONE}"):
                rows = self.spark.read.schema("batch_id string").parquet(f"{self.path}/_versions/{name}").collect()
                return int(name.removeprefix("v=")), sorted(r["batch_id"] for r in rows)
        return 0, []

    def compact(self, closed: Iterable[int | str]) -> int:
        """Rewrite the closed batches, with what was compacted before, as one folder by type and day; the new version.

        A closed batch is never written again. Busy days are split by size, all others get
        one file for each type and day, however many batches they came in.
        """
        number, held = self.version()
        wanted = sorted({str(b) for b in closed} & set(self.batches()) - set(held))
        if not wanted:
            return number
        rows = self._rows(number if held else None, wanted)
        number = self._next()
        write_facts(rows, self._compacted(number), "overwrite")
        listed = self.spark.createDataFrame([(b,) for b in [*held, *wanted]], "batch_id string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_versions/v={number:08d}")
        return number

    def _next(self) -> int:
        """A number after all versions, complete or not."""
        names = [*folders(self.spark, f"{self.path}/_versions"), *folders(self.spark, f"{self.path}/_compacted")]
        return max([0, *(int(n.removeprefix("v=")) for n in names)]) + 1

    def _compacted(self, number: int) -> str:
        return f"{self.path}/_compacted/v={number:08d}"

    def _rows(self, number: int | None, batches: list[str]) -> DataFrame:
        """The rows of a version's folder and of single batches."""
        parts = [self.spark.read.parquet(self._compacted(number))] if number else []
        if batches:
            paths = [f"{self.path}/batch_id={b}" for b in batches]
            parts.append(self.spark.read.option("basePath", self.path).parquet(*paths).drop("batch_id"))
        if not parts:
            raise ValueError(f"no facts are stored in {self.path}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self) -> DataFrame:
        """All facts once: those of the newest version and of the batches after it."""
        number, held = self.version()
        return self._rows(number if held else None, [b for b in self.batches() if b not in held])

    def vacuum(self) -> list[str]:
        """Remove the folders that the newest version replaces; readers of older versions must have ended. The removed names."""
        number, held = self.version()
        old = [f"batch_id={b}" for b in held] + [f"_compacted/{n}" for n in folders(self.spark, f"{self.path}/_compacted") if int(n[2:]) < number]
        jvm = self.spark.sparkContext._jvm
        for name in old:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return old
