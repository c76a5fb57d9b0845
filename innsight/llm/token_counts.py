"""Token counts through a cache of counts by content digest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm._tokens import ENCODERS, encoder, version_of
from innsight.llm._work import slices

CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest.

    A retried append or two concurrent ones may have stored a digest twice, with
    the same count; the grouping takes one.
    """
    rows = spark.createDataFrame([], CACHE_SCHEMA)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(tokenizer_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for part in slices(batches, keep=ENCODERS):
            counts = encode.count(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def count_tokens(
    documents: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_tokens: int = 1024,
) -> DataFrame:
    """Number of tokens of every text, as ``id, n_bytes, n_tokens, over_limit``.

    The content of a text is normalised (null is the empty text; nothing else,
    for anything more could change the count) and digested with SHA-256. Digests
    that the cache at ``cache_path`` holds for this tokenizer version are only
    looked up. Of the others one text per digest is encoded, whole, and its
    count is appended to the cache, partitioned by version; then all rows look
    up theirs. Only digests are shuffled for the grouping and the look-ups; the
    texts move once, in the join with the digests still missing, which adaptive
    execution turns into a broadcast when few are missing and measured small.

    One row comes back per input row, repeated rows and null ids included; an
    empty table gives an empty one. Further columns of the input are ignored.
    """
    spark = documents.sparkSession
    version = version_of(tokenizer_path)
    rows = documents.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    ).withColumn("_digest", F.unhex(F.sha2("_text", 256)))

    holders = rows.groupBy("_digest").agg(F.min("_id").alias("_holder"))
    known = read_cache(spark, cache_path, version)
    missing = holders.join(known, holders._digest == known.digest, "left_anti").select(
        F.col("_digest").alias("digest"), "_holder"
    )
    texts = rows.join(
        missing, (rows._digest == missing.digest) & rows._id.eqNullSafe(missing._holder), "left_semi"
    ).select("_digest", "_text")
    (
        texts.mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens long")
        .withColumn("version", F.lit(version))
        .write.mode("append")
        .partitionBy("version")
        .parquet(cache_path)
    )

    counts = read_cache(spark, cache_path, version)
    sized = rows.select("_id", "_digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    return sized.join(counts, sized._digest == counts.digest, "left").select(
        F.col("_id").alias(id_column),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > max_tokens).alias("over_limit"),
    )
