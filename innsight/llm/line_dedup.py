"""Removal of lines that an earlier document holds already."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from innsight.llm._work import column_type, slices, stored

_BLANKS = b" \t\n\v\f\r"
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("txt", pa.int64()), ("pos", pa.int64())])
_FOUND = pa.schema([("kind", pa.int32()), *_LINES])
#: Kinds of rows that a task of the sorted lines gives.
DROPPED, FIRST_HERE, OPEN = 0, 1, 2


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without blanks at its ends, A-Z lower-cased; None below ``least`` code points."""
    key = line.strip(_BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _hashed(least: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests, docs, texts, places = [], [], [], []
            for doc, txt, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for at, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line, least)
                    if key is not None:
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        docs.append(doc)
                        texts.append(txt)
                        places.append(at)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (halves[:, 0].copy(), halves[:, 1].copy(), docs, texts, places)],
                schema=_LINES,
            )

    return lines


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream lines sorted by hash, document and place; give those outside the first document of their hash.

    The run of hashes that a task begins with may have begun in an earlier task:
    its lines in the first document seen here are given as ``FIRST_HERE``. The
    run that it ends with may go on in a later one: it is given as ``OPEN``.
    """
    run, first, leading, last = None, None, None, None
    for batch in batches:
        h1, h2, doc, txt, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(h1)
        if not n:
            continue
        begins = np.empty(n, bool)
        begins[0] = run != (h1[0], h2[0])
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if leading is None:
            leading = (h1[0], h2[0])
        starts = np.flatnonzero(begins)
        number = np.cumsum(begins)  # 0: the run of the batch before
        firsts = np.concatenate([[0 if first is None else first], doc[starts]])
        own_first = firsts[number]
        drop = doc != own_first
        lead = (h1 == leading[0]) & (h2 == leading[1]) & ~drop
        run, first = (h1[-1], h2[-1]), firsts[number[-1]]
        last = (h1[-1], h2[-1], first, txt[-1], pos[-1])
        keep = drop | lead
        kinds = np.where(drop, DROPPED, FIRST_HERE)[keep].astype("int32")
        columns = [pa.array(kinds), *(pa.array(c[keep]) for c in (h1, h2, doc, txt, pos))]
        yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)
    if last is not None:
        values = [OPEN, *last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, _FOUND, strict=True)], schema=_FOUND
        )


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        maps, counts = [], []
        for places in part.column(2):
            places = np.unique(places.values.to_numpy(zero_copy_only=False))
            bits = np.ones(int(places[-1]) // 8 * 8 + 8, bool)  # whole bytes, the rest kept
            bits[places] = False
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            counts.append(len(places))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
            ["doc", "txt", "n_dropped", "keep_bitmap"],
        )


def keep_lines(text: str | None, bitmap: bytes | None) -> str:
    """``text`` without the lines whose bit in ``bitmap`` is off; lines beyond its end stay."""
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return "\n".join(line for at, line in enumerate(lines) if at >= len(bits) or bits[at])


def _identified(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text_column).alias("txt"),
        F.col(text_column).alias("_text"),
        F.col(id_column).alias("_id"),
    )


def line_bitmaps(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10
) -> DataFrame:
    """Keep bitmaps ``doc, txt, n_dropped, keep_bitmap`` of the documents that lose lines.

    Lines are hashed (128 bits), range-partitioned by hash, document and place
    and sorted within; each task streams over its range and keeps the lines of
    the first document of each hash. As the range takes in document and place, a
    line that millions of documents share spreads over as many tasks as its rows
    need; the first documents of hashes at range ends, one row per task, correct
    the tasks after them. ``keep_bitmap`` is a zlib-compressed bit per line,
    lowest bit first, up to the last dropped line; all documents without a row
    keep every line. ``doc`` is the integer id, ``txt`` a hash of the text, so
    that rows which share an id each get their own bitmap.

    Null texts are one empty line. Rows of a null id count as one document after
    all others. Keys below ``least`` code points are never dropped. Rows that
    repeat an id are one document: none of them loses lines to the other.
    """
    rows = _identified(documents, id_column, text_column).select("doc", "txt", "_text")
    lines = stored(rows.mapInArrow(_hashed(least), "h1 long, h2 long, doc long, txt long, pos long"), "lines")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "txt", "pos"]
    found = stored(
        lines.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_first_occurrences, "kind int, h1 long, h2 long, doc long, txt long, pos long"),
        "line-runs",
    )
    openers = found.filter(F.col("kind") == OPEN).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    late = (
        found.filter(F.col("kind") == FIRST_HERE)
        .join(openers, ["h1", "h2"])
        .filter(F.col("first") < F.col("doc"))
        .select("doc", "txt", "pos")
    )
    dropped = found.filter(F.col("kind") == DROPPED).select("doc", "txt", "pos").unionByName(late)
    return (
        dropped.groupBy("doc", "txt")
        .agg(F.collect_set("pos").alias("places"))
        .mapInArrow(_bitmap, "doc long, txt long, n_dropped long, keep_bitmap binary")
    )


def with_bitmaps(documents: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents``' id (``_id``), text (``_text``), ``n_dropped`` (0 if none) and ``keep_bitmap``."""
    rows = _identified(documents, id_column, text_column)
    return rows.join(bitmaps, ["doc", "txt"], "left").select(
        "_id", "_text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap"
    )


@F.pandas_udf(StringType())
def kept_text(text, bitmap):
    """The lines of a text that its bitmap keeps."""
    import pandas as pd

    return pd.Series([keep_lines(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


#: Else a filter on the result has it computed twice, in two Python workers for each task.
kept_text = kept_text.asNondeterministic()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        counts, digests = [], []
        for text, bitmap in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
            counts.append((text or "").count("\n") + 1)
            digests.append(hashlib.sha256(keep_lines(text, bitmap).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), part.column(2), pa.array(digests, pa.string())],
            ["_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_report(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10) -> DataFrame:
    """``id, n_lines, n_dropped, kept_sha256`` of every row, the digest being of its kept text."""
    joined = with_bitmaps(documents, line_bitmaps(documents, id_column, text_column, least), id_column, text_column)
    kind = column_type(documents, id_column)
    return joined.mapInArrow(
        _reports, f"_id {kind}, n_lines long, n_dropped long, kept_sha256 string"
    ).withColumnRenamed("_id", id_column)
