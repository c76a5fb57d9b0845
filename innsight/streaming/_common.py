"""Running a stream over what is there, and reading back what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, in the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting uses a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="innsight-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """Parquet files of ``folder`` matching ``pattern``, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).foreachBatch(work)


def put(rows: DataFrame, folder: str, batch: int) -> None:
    """Write one batch's rows to a place named after the batch: a replay overwrites itself."""
    rows.write.mode("overwrite").parquet(f"{folder}/lote={batch}")


@dataclass(frozen=True)
class LatestRows:
    """The newest row per key, kept as what each batch changed.

    A batch writes the rows of the keys it changed, to a place named after it; a
    replay overwrites itself. Every ``every`` batches the whole state is written
    instead, and what lies before the whole state before that is removed. So a
    batch's bytes follow the keys it changed, and a reader opens ``every``
    places at most.
    """

    spark: SparkSession
    folder: str
    key: list[str]
    schema: str
    every: int = 16

    def _base(self, batch: int) -> int:
        return batch - batch % self.every

    def _path(self, batch: int) -> str:
        return f"{self.folder}/lote={batch}"

    def write(self, rows: DataFrame, batch: int) -> None:
        if batch and batch == self._base(batch):
            before = self.read(batch - 1)
            same = [before[k].eqNullSafe(rows[k]) for k in self.key]
            rows = before.join(rows, same, "left_anti").unionByName(rows)
        put(rows, self.folder, batch)
        if batch == self._base(batch):
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for old in range(max(0, batch - 2 * self.every), batch - self.every):
                path = hadoop(self._path(old))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, batch: int | None = None) -> DataFrame:
        """State after ``batch``, by default after the newest one that is there."""
        there = self._there()
        batch = max(there, default=-1) if batch is None else batch
        paths = [self._path(b) for b in there if self._base(batch) <= b <= batch]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(f"{self.schema}, lote long").option("basePath", self.folder).parquet(*paths)
        others = [c for c in stored.columns if c not in (*self.key, "lote")]
        newest = stored.groupBy(*self.key).agg(F.max(F.struct("lote", *others)).alias("u"))
        return newest.select(*self.key, *[F.col(f"u.{c}").alias(c) for c in others])

    def _there(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("lote=")) for n in names if n.startswith("lote="))
