"""Packing of token ids into sequences of fixed length, first fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._tokens import ENCODERS, encoder
from innsight.llm._work import column_type, slices, stored

#: Tails packed together by one task.
GROUP_ROWS = 4096
#: Rows, and bytes of text, that are encoded at once: words that texts share are looked up once for all of them.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
#: A gap in a sequence is filled with a cut piece if it has so many ids.
LEAST_CUT = 16


class Tournament:
    """Free room of a fixed number of bins, the larger of two winning at each node.

    ``take(size)`` finds the first bin with room for ``size`` in logarithmic
    time and takes the room from it.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, which come sorted from large to small."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = tree.take(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Move pieces ``(item, from, to)`` of the emptiest bins into gaps of the fullest ones.

    A piece is cut only where it is longer than the gap. Gaps below ``least`` ids
    stay. The one bin that remains partly filled is split into bins that are
    powers of two, which need no padding.
    """
    length = lambda b: sum(to - at for _, at, to in b)
    bins = sorted((list(b) for b in bins), key=length, reverse=True)
    room = [capacity - length(b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if room[i] < least:
            i += 1
        elif not bins[j]:
            j -= 1
        else:
            item, at, to = bins[j].pop()
            moved = min(room[i], to - at)
            bins[i].append((item, at, at + moved))
            if at + moved < to:
                bins[j].append((item, at + moved, to))
            room[i] -= moved
            room[j] += moved
    bins = [b for b in bins if b]
    if not bins or capacity - length(bins[-1]) < least:
        return bins
    rest, left = bins.pop(), 0
    left = length(rest)
    while rest:
        wanted, part = 1 << (left.bit_length() - 1), []
        left -= wanted
        while wanted:
            item, at, to = rest.pop()
            moved = min(wanted, to - at)
            part.append((item, at, at + moved))
            if at + moved < to:
                rest.append((item, at + moved, to))
            wanted -= moved
        bins.append(part)
    return bins


def _cutter(tokenizer_path: str, capacity: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        seen: dict = {}
        for part in slices(batches, SLICE_ROWS, ENCODERS, SLICE_BYTES):
            ids_of_rows = encode.encode(part.column(1).to_pylist())
            rows: list[tuple] = []
            for key, ids in zip(part.column(0).to_pylist(), ids_of_rows, strict=True):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                # rows with one id, repeated ones too, are told apart by their turn
                crc = zlib.crc32(ids)
                turn = 0
                if key is None or (key, crc) in seen:
                    turn = seen.get((key, crc), 0)
                seen[key, crc] = turn + 1
                if len(seen) > 1_000_000:
                    seen.clear()
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    piece = zlib.crc32(ids[4 * at : 4 * (at + capacity)])
                    rows.append((key, at, capacity, piece, total, None, crc, turn))
                if whole < total:
                    rows.append((key, whole, total - whole, None, total, ids[4 * whole :], crc, turn))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return cut


def _packer(capacity: int, least: int, out: pa.Schema):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["_crc"], r["_turn"], str(r["_id"]), r["start"]))
        bins = first_fit_decreasing([r["length"] for r in rows], capacity)
        pieces = fill_gaps([[(i, 0, rows[i]["length"]) for i in b] for b in bins], capacity, least)
        packed = []
        for n, content in enumerate(pieces):
            at = 0
            for i, low, high in content:
                r = rows[i]
                crc = zlib.crc32(r["_ids"][4 * low : 4 * high])
                # even numbers: the full pieces have the odd ones
                place = 2 * (group * GROUP_SEQUENCES + n)
                packed.append((r["_id"], r["start"] + low, high - low, crc, r["doc_tokens"], place, at))
                at += high - low
        columns = list(zip(*packed, strict=True)) if packed else [[]] * len(out)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return pack


#: Sequence numbers set aside for each group; a group has fewer rows.
GROUP_SEQUENCES = 1 << 24


def _arrow(ddl_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl_type))


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 1024,
    group_rows: int = GROUP_ROWS,
    least_cut: int = LEAST_CUT,
    seed: int = 7,
) -> DataFrame:
    """Pieces ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all documents.

    A document is its ids and an end id 0. Its full ``capacity`` pieces are
    sequences of their own. What is left of each document, its tail, goes with
    about ``group_rows`` others to a group drawn by a hash; in each group tails
    are placed first fit decreasing, the first bin with room found in a
    tournament tree of bin capacities. Gaps of ``least_cut`` ids or more are then
    filled by cutting pieces of the emptiest bins, so of each group one bin at
    most is left partly filled, and that one is split at powers of two.

    Null texts are empty (one id). Repeated rows are packed each for itself, and
    null ids stay null; a turn number within the reading task keeps many rows of
    one id and text from falling into one group. An empty table gives no pieces.
    Further columns of the input are ignored.
    """
    kind = column_type(documents, id_column)
    rows = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    cut_ddl = (
        f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _ids binary, _crc long, _turn long"
    )
    cut_schema = pa.schema(
        [("_id", _arrow(kind))]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
        + [("_ids", pa.binary()), ("_crc", pa.int64()), ("_turn", pa.int64())]
    )
    pieces = stored(
        rows.mapInArrow(_cutter(tokenizer_path, capacity, cut_schema), cut_ddl).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    full = pieces.filter(F.col("_ids").isNull()).select(
        "_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    tails = pieces.filter(F.col("_ids").isNotNull())
    groups = max(1, round(tails.count() / group_rows))
    out_ddl = (
        f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    out_schema = pa.schema(
        [("_id", _arrow(kind))]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )
    packed = (
        tails.select("_id", "start", "length", "doc_tokens", "_ids", "_crc", "_turn")
        .withColumn("_group", F.pmod(F.xxhash64("_id", "_crc", "_turn", F.lit(seed)), F.lit(groups)))
        .groupBy("_group")
        .applyInArrow(_packer(capacity, least_cut, out_schema), out_ddl)
    )
    return full.unionByName(packed).withColumnRenamed("_id", id_column)
