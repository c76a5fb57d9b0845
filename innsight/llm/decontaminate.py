"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import column_type, slices, stored

_WORD = re.compile(r"\w+")
#: Most bits of the filter of seed hashes that travels with the tasks (2 MB).
FILTER_BITS = 24


def rolling_hashes(text: str | None, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` lower-cased words, by place; signed 64 bits.

    A text of fewer words has one hash, of all of them, which only the same words alone have.
    """
    words = [w.encode() for w in _WORD.findall((text or "").lower())]
    if len(words) < width:
        whole = [xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else []
        return np.array(whole, np.uint64).view(np.int64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + single[i : i + n]
    return rolled.view(np.int64)


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def tiling(doc_places: np.ndarray, item_places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles ``doc, item, words`` of greedy string tiling over places where ``width`` words are equal.

    Runs of equal seeds on one diagonal are the maximal matches. The longest one
    is marked, then the longest of what the others keep outside marked words of
    either text, and so on down to ``width`` words.
    """
    order = np.lexsort((doc_places, doc_places - item_places))
    d, i = doc_places[order], item_places[order]
    ends = np.flatnonzero(np.r_[(np.diff(d - i) != 0) | (np.diff(d) != 1), True])
    starts = np.r_[0, ends[:-1] + 1]
    # longest first, then by place in the item and in the document
    runs = [(-(int(e - s) + width), int(i[s]), int(d[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(runs)
    used_d: set[int] = set()
    used_i: set[int] = set()
    tiles = []
    while runs:
        negative, at_i, at_d = heapq.heappop(runs)
        length = -negative
        free = [k for k in range(length) if at_d + k not in used_d and at_i + k not in used_i]
        if len(free) == length:
            tiles.append((at_d, at_i, length))
            used_d.update(range(at_d, at_d + length))
            used_i.update(range(at_i, at_i + length))
            continue
        begin = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - begin >= width:
                    heapq.heappush(runs, (begin - k, at_i + free[begin], at_d + free[begin]))
                begin = k
    return tiles


def _seeds(width: int, names: tuple[str, str]):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [rolling_hashes(t, width) for t in part.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            places = np.concatenate([np.arange(n) for n in sizes]) if found else np.empty(0, int)
            hashes = np.concatenate(found) if found else np.empty(0, int)
            words = np.repeat([len(_WORD.findall((t or "").lower())) for t in part.column(1).to_pylist()], sizes)
            columns = [keys, *(pa.array(c, pa.int64()) for c in (places, hashes, words))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "hash", "words"])

    return seeds


def _filtered(width: int, packed: bytes, bits: int):
    """Seeds of documents whose hash passes the filter, as ``key, place, hash``."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for part in slices(batches):
            rows, places, hashes = [], [], []
            for n, text in enumerate(part.column(2).to_pylist()):
                found = rolling_hashes(text, width)
                at = np.flatnonzero(there[_bits(found, bits)]) if len(found) else found
                rows.append(np.full(len(at), n))
                places.append(at)
                hashes.append(found[at])
            rows = pa.array(np.concatenate(rows).astype(int))
            columns = [part.column(0).take(rows), part.column(1).take(rows)]
            columns += [pa.array(np.concatenate(x), pa.int64()) for x in (places, hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_txt", "place", "hash"])

    return seeds


def _tiled(width: int, percent: int):
    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            keep, covered, tiles, longest = [], [], [], []
            for n, (points, words) in enumerate(zip(part.column("points"), part.column("words").to_pylist(), strict=True)):
                at = points.values
                # the seed of a text below ``width`` words is all of it
                found = tiling(at.field(0).to_numpy(), at.field(1).to_numpy(), min(width, words))
                total = sum(t[2] for t in found)
                if 100 * total >= percent * words:
                    keep.append(n)
                    covered.append(total)
                    tiles.append(len(found))
                    longest.append(max(t[2] for t in found))
            some = part.take(pa.array(keep, pa.int64()))
            columns = [some.column(c) for c in ("_id", "_txt", "_item", "words")]
            columns += [pa.array(c, pa.int64()) for c in (covered, tiles, longest)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_txt", "_item", "words", "covered", "tiles", "longest"])

    return tiled


def _pairs(
    documents: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str,
    item_text_column: str, width: int, percent: int,
) -> DataFrame:
    """``_id, _txt, _item, words, covered, tiles, longest`` of the pairs that reach the coverage; ``_txt`` is the text's hash."""
    spark = documents.sparkSession
    kind, item_kind = column_type(documents, id_column), column_type(benchmark, item_column)
    items = benchmark.select(F.col(item_column).alias("_item"), F.col(item_text_column).alias("_text"))
    items = items.groupBy("_item", "_text").count().withColumn("_key", F.monotonically_increasing_id())
    items = stored(items, "items")
    item_seeds = stored(
        items.select("_key", "_text").mapInArrow(_seeds(width, ("_key", "at")), "_key long, at long, hash long, words long"),
        "item-seeds",
    )
    lengths = item_seeds.groupBy("_key").agg(F.max("words").alias("words"))
    item_seeds = item_seeds.drop("words")
    n = item_seeds.count()
    bits = min(FILTER_BITS, max(10, int(16 * n + 1).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    octets = item_seeds.select(place.alias("b")).groupBy(F.expr("b div 8").alias("o")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(7 - b % 8 as int))")).alias("m")
    )
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in octets.collect():  # bounded by the filter's size
        packed[r["o"]] = r["m"]

    rows = documents.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_txt"), F.col(text_column).alias("_text")
    )
    seeds = rows.mapInArrow(
        _filtered(width, packed.tobytes(), bits), f"_id {kind}, _txt long, place long, hash long"
    ).distinct()
    seeds = stored(seeds, "seeds")

    shared = item_seeds.groupBy("hash").agg(F.countDistinct("_key").alias("items"))
    ranked = (
        item_seeds.select("_key", "hash")
        .distinct()
        .join(shared, "hash")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list(F.struct("items", "hash"))).alias("found"))
        .join(lengths, "_key")
    )
    needed = F.ceil(F.col("words") * percent / (100.0 * width))
    # one seed at several places of an item may cover much of it: such items leave none out
    plain = F.size("found") == F.col("words") - (width - 1)
    rare = F.when(plain, F.greatest(F.lit(1), F.size("found") - needed + 1)).otherwise(F.size("found"))
    first = ranked.select("_key", F.explode(F.slice("found", F.lit(1), rare.cast("int"))).alias("s")).select(
        "_key", F.col("s.hash").alias("hash")
    )
    who = ["_id", "_txt"]
    candidates = seeds.select(*who, "hash").distinct().join(first, "hash").select(*who, "_key").distinct()
    same = [F.col("s._id").eqNullSafe(F.col("c._id")), F.col("s._txt") == F.col("c._txt")]
    met = (
        candidates.alias("c")
        .join(seeds.alias("s"), same)
        .select("c._id", "c._txt", "c._key", "s.place", "s.hash")
        .join(item_seeds, ["_key", "hash"])
        .groupBy("_id", "_txt", "_key")
        .agg(F.collect_list(F.struct("place", "at")).alias("points"))
        .join(lengths, "_key")
        .join(items.select("_key", "_item"), "_key")
        .select("_id", "_txt", "_item", "points", "words")
    )
    ddl = f"_id {kind}, _txt long, _item {item_kind}, words long, covered long, tiles long, longest long"
    return met.mapInArrow(_tiled(width, percent), ddl)


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = 5,
    percent: int = 50,
) -> DataFrame:
    """Pairs ``id, item, n_item_words, n_covered, n_tiles, longest_tile`` of documents that cover a benchmark item.

    Texts are lower-cased word sequences. A seed is ``width`` equal words; greedy
    string tiling covers the item with non-overlapping matches, the longest
    first, wherever they stand in the document, so a passage whose parts were put
    in another order counts in full. A pair is returned if its tiles hold
    ``percent`` hundredths of the item's words or more. Items of fewer than
    ``width`` words are covered by texts of the same words alone.

    Documents are scanned once with a bit filter of seed hashes, at most
    ``2 ** FILTER_BITS`` bits however large the benchmark, and only passing seeds
    are shuffled. To reach the coverage a pair must share at least
    ``percent * words / width`` seeds of the item, so a document is a candidate
    only if it holds a seed outside the item's most frequent ones of that number:
    a phrase that opens every item makes no candidates. Seeds of candidates are
    then gathered, one row per pair, bounded by the length of the two texts.

    Null texts have no words. Rows that share an id and a text give one pair, null
    ids included; rows of one id with different texts are tiled apart and give the
    fuller one. Empty tables on either side give no pairs; further columns are ignored.
    """
    pairs = _pairs(documents, benchmark, id_column, text_column, item_column, item_text_column, width, percent)
    best = pairs.groupBy("_id", "_item").agg(F.max(F.struct("covered", "words", "longest", "tiles")).alias("b"))
    return best.select(
        F.col("_id").alias(id_column),
        F.col("_item").alias(item_column),
        F.col("b.words").alias("n_item_words"),
        F.col("b.covered").alias("n_covered"),
        F.col("b.tiles").alias("n_tiles"),
        F.col("b.longest").alias("longest_tile"),
    )


def without_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = 5,
    percent: int = 50,
) -> DataFrame:
    """``documents`` without the rows whose own text covers a benchmark item (see ``contaminated``)."""
    pairs = _pairs(documents, benchmark, id_column, text_column, item_column, item_text_column, width, percent)
    gone = pairs.select(F.col("_id").alias("_key"), "_txt").distinct()
    same = F.col(id_column).eqNullSafe(F.col("_key")) & (F.xxhash64(text_column) == F.col("_txt"))
    return documents.join(gone, same, "left_anti")
