"""What the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from innsight.llm._work import CLEANUP, stored


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_stored_steps_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    counted = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).count()
    kept = stored(counted.join(spark.range(10).toDF("k").repartition("k"), "k"), "work-test")
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP) == setting
    assert {(r.k, r["count"]) for r in kept.collect()} == {(k, 100) for k in range(10)}


def test_a_step_can_be_stored_twice(spark):
    counted = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    once, twice = stored(counted, "work-test"), stored(counted, "work-test")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_workers_get_small_batches_while_a_step_is_stored(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    kept = stored(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "work-test")
    assert sorted(r.n for r in kept.collect()) == [904, 2048, 2048]
    assert spark.conf.get(name) == before
