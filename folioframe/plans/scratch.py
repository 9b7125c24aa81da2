"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a step is written: its shuffle files go when it ends, and rows cross to Python in smaller batches, which bounds
#: what both sides hold of long texts.
DURING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2500"}
#: While a wide step is written: its shuffles have many partitions, which adaptive execution puts together up to a size (their
#: number alone would let a task grow with the input), and its scans small splits, since a task's partial sums follow its rows.
WIDE = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "384", "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

#: While a step of long texts is written: a worker holds a batch, what it makes of it and its Arrow form at once.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "128", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one, a single-machine session gets a
    folder under its warehouse; a cluster gets an error, for its executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to survive lost executors.

    The shuffle files of a written step are released when the write ends, since later steps read the table. Frames made
    of these tables may be read as long as the session lives; the tables go when it ends, or by ``clear``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: list[str] = []
        where = self._path(self.root)
        where.getFileSystem(self._conf()).deleteOnExit(where)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def clear(self) -> None:
        """Removes all tables; nothing made of them may be read any more."""
        where = self._path(self.root)
        where.getFileSystem(self._conf()).delete(where, True)
        self.paths = []

    @contextlib.contextmanager
    def _released(self, wide: bool = False, small: bool = False):
        during = DURING | (WIDE if wide else {}) | (SMALL if small else {})
        before = {k: self.spark.conf.get(k, None) for k in during}
        for k, v in during.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def write(self, df: DataFrame, compression: str = "zstd", wide: bool = False, small: bool = False) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        self.paths.append(path)
        with self._released(wide, small):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a written table that no later step reads."""
        for path in [p for p in self.paths if any(f"{p.split('://')[-1]}/" in f for f in df.inputFiles()[:1])]:
            where = self._path(path)
            where.getFileSystem(self._conf()).delete(where, True)
            self.paths.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
