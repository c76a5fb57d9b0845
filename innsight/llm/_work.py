"""Shared folders, and loops over Arrow batches, for the operators of this package."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows whose Python objects exist at once; texts of a batch can be long.
SLICE = 512
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What holds while a step is written: its shuffle files go with it, and Python workers get their rows in
#: small batches, as a batch exists several times at once on both sides of the pipe.
STORING = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session may do without that setting; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="innsight-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work done once, lineage cut.

    Nobody reads the shuffle files of a written step again, so Spark is asked to
    remove them with the write instead of some time after.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = {name: spark.conf.get(name) for name in STORING}
    try:
        for name, value in STORING.items():
            spark.conf.set(name, value)
        df.write.parquet(folder)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(folder)


def column_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task, until a task that doesn't name it begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _pieces(batch: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    """``batch`` halved until a piece has ``size`` bytes or a single row."""
    if size is None or batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    middle = batch.num_rows // 2
    yield from _pieces(batch.slice(0, middle), size)
    yield from _pieces(batch.slice(middle), size)


def slices(
    batches: Iterator[pa.RecordBatch], rows: int = SLICE, keep: str | None = None, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` rows and ``size`` bytes at most; memory that other tasks kept, but for ``keep``, is given back first."""
    others = [name for name in _kept if name != keep]
    for name in others:
        del _kept[name]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _pieces(batch.slice(at, rows), size)
