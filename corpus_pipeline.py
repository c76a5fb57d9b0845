"""Five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before it kept; all but the last return the columns of ``documents``,
whatever further columns come in. A stage decides on rows by id and text, so rows
without an id, or with one id and different texts, fare each on its own. Rows
equal in both pass the language and line stages together and are one document
from near-duplicate removal on. Null and empty texts go with the language stage.
An empty table passes all stages empty. ``run`` writes each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import decontaminate, language, line_dedup, near_dup, packing
from innsight.llm._work import stored
from innsight.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected: no text, no letters, or a score below the calibrated threshold."""
    docs = docs.select(*COLUMNS)
    model = language.train(docs.filter(~language.held_out()))
    return language.predict_languages(docs, model, carried=tuple(COLUMNS[1:])).filter("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without any visible character goes with them. Null texts become empty."""
    docs = docs.select(*COLUMNS)
    bitmaps = line_dedup.line_bitmaps(docs)
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    rows = docs.withColumns({"doc": key, "txt": F.xxhash64("text")})
    cut = rows.join(bitmaps, ["doc", "txt"], "left").withColumn("text", line_dedup.kept_text("text", "keep_bitmap"))
    left = cut.filter(F.col("keep_bitmap").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, and of rows equal in id and text one."""
    return near_dup.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half or more of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs.select(*COLUMNS), benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language identification and packing can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
