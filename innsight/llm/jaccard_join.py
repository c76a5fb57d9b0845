"""N-gram Jaccard join by vertical partitioning: overlaps are counted fragment by fragment of the global n-gram order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm._rounds import in_company, link_blocks
from innsight.llm._work import column_type, slices, stored
from innsight.llm.near_dup import shingle_hashes

#: Fragments that the global order is cut into.
FRAGMENTS = 4
#: The lowest hashes of a set that are looked at first: so many times what a similar set may lack, and one.
REGION = 2
#: Bits of a hash that are posted for that, and digests that a task remembers.
KEY_BITS, REMEMBERED = 48, 100_000


def _listed(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def spare(size: int, percent: int) -> int:
    """How many n-grams of a set a similar enough set may lack."""
    return size - -(-size * percent // 100)


def _digested(width: int, percent: int):
    """Size and digest of each row's set, and its lowest hashes unless the task has just given those of an equal set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, 256):
            sizes, digests, lowest = [], [], []
            for text in part.column(2).to_pylist():
                found = shingle_hashes(text, width)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                looked = 0 if digest is None or digest in seen else REGION * spare(len(found), percent) + 1
                seen.add(digest)
                sizes.append(len(found))
                digests.append(digest)
                lowest.append((found[:looked] >> np.uint64(64 - KEY_BITS)).view(np.int64))
            if len(seen) > REMEMBERED:
                seen.clear()
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _listed(lowest)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *arrays], ["_id", "_txt", "size", "digest", "lowest"]
            )

    return run


def _gathered(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = [shingle_hashes(t, width).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _listed(found)], ["cid", "grams"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row`` of the entries, sorted by ``key``, whose key has another entry."""
    key, row, repeated = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        # the last entry waits for the one after it
        key, row = np.r_[key[-1:], batch.column(0).to_numpy()], np.r_[row[-1:], batch.column(1).to_numpy()]
        same, waiting = key[1:] == key[:-1], repeated[-1:]
        repeated = np.zeros(len(key), bool)
        repeated[: len(waiting)] = waiting
        repeated[1:] |= same
        repeated[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(row[:-1][repeated[:-1]])], ["row"])
    yield pa.RecordBatch.from_arrays([pa.array(row[-1:][repeated[-1:]])], ["row"])


def promising(digested: DataFrame, percent: int) -> DataFrame:
    """``digest`` of the sets that can have a similar one, by their lowest hashes.

    Of any part of a set a similar set lacks at most ``spare`` n-grams; so all
    others of its lowest ones must be held by some other row. A text that only
    has a passage in common with others fails that. Keys are the upper bits of
    the hashes: two that coincide, or two rows with equal sets, let a set pass
    that resembles none, which costs time only.
    """
    posted = digested.select(F.explode("lowest").alias("key"), "row").repartition("key").sortWithinPartitions("key")
    met = posted.mapInArrow(_repeated, "row long").groupBy("row").agg(F.count(F.lit(1)).alias("shared"))
    return (
        digested.select("row", "digest", "size", F.size("lowest").alias("looked"))
        .join(met, "row")
        .filter(f"shared >= looked - (size - (size * {percent} + 99) div 100)")
        .select("digest")
        .distinct()
    )


def ordered_sets(sets: DataFrame) -> DataFrame:
    """``cid, size, grams`` with the n-grams that two sets or more hold, from rare to frequent.

    ``o`` places an n-gram in the global order by the number of sets that hold
    it and its hash. N-grams of one set alone come before all others and can't
    be common to two: they only count in ``size``. A set may come twice, from
    repeated rows.
    """
    single = sets.select("cid", F.size("grams").cast("long").alias("size"), F.explode("grams").alias("key"))
    order = F.expr("shiftleft(n, 32) + shiftrightunsigned(key, 32)")
    return (
        in_company(single)
        .groupBy("cid", "size")
        .agg(F.sort_array(F.collect_set(F.struct(order.alias("o"), "key"))).alias("grams"), F.sum("n").alias("weight"))
    )


def borders_of(ordered: DataFrame, fragments: int) -> list[int]:
    """Places that cut the global order into fragments of about equal numbers of entries."""
    shares = [i / fragments for i in range(1, fragments)]
    places = ordered.select(F.explode("grams.o").alias("o")).agg(F.percentile_approx("o", shares, 1000)).first()[0]
    return sorted(set(places or []))


def segments_of(ordered: DataFrame, borders: list[int]) -> DataFrame:
    """``cid, fragment, grams``: the sets cut vertically, one row per set and fragment where it has n-grams."""
    low, high = [None, *borders], [*borders, None]

    def inside(i: int):
        def test(gram: Column) -> Column:
            above = F.lit(True) if low[i] is None else gram["o"] >= low[i]
            return above if high[i] is None else above & (gram["o"] < high[i])

        return test

    parts = [F.filter("grams", inside(i))["key"] for i in range(len(low))]
    cut = ordered.select("cid", F.posexplode(F.array(*parts)).alias("fragment", "grams"))
    return cut.filter(F.size("grams") > 0)


def blocks_of(ordered: DataFrame, percent: int) -> DataFrame:
    """Postings ``key, cid, size, rest, weight``; two similar enough sets meet under the first n-gram they share.

    A set is posted under its n-grams that have ``percent`` hundredths of the set
    from there on; ``rest`` is that number.
    """
    posts = F.size("grams") - F.expr(f"(size * {percent} + 99) div 100") + 1
    some = ordered.withColumn("posts", posts.cast("int")).filter("posts > 0")
    return some.select(
        "cid", "size", "weight", F.size("grams").alias("_all"), F.posexplode(F.slice("grams", F.lit(1), F.col("posts")))
    ).select(
        F.col("col.key").alias("key"), "cid", "size", (F.col("_all") - F.col("pos")).cast("long").alias("rest"), "weight"
    )


def _met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of one block, of different components, that can still be similar enough.

    If a block's n-gram is the first that two sets share, they have no more in
    common than the smaller ``rest``. A pair that fails that in one block stands
    in the block of its first common n-gram all the same.
    """
    a = left.select("key", *[F.col(c).alias(f"{c}_a") for c in ("cid", "size", "rest", "comp")])
    b = right.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cid", "size", "rest", "comp")])
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("size_a") + F.col("size_b"))
    first = F.col("cid_a") < F.col("cid_b")
    return a.join(b, "key").filter((F.col("comp_a") != F.col("comp_b")) & enough).select(
        *[F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(n) for c, n in (("cid", "a"), ("size", "sa"))],
        *[F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(n) for c, n in (("cid", "b"), ("size", "sb"))],
    )


def similar(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose overlap, counted in each fragment and summed, is large enough."""
    one = segments.select(F.col("cid").alias("a"), "fragment", F.col("grams").alias("xa"))
    two = segments.select(F.col("cid").alias("b"), "fragment", F.col("grams").alias("xb"))
    partial = pairs.join(two, "b").join(one, ["a", "fragment"])
    summed = partial.groupBy("a", "b", "sa", "sb").agg(F.sum(F.size(F.array_intersect("xa", "xb"))).alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("sa") + F.col("sb") - F.col("common"))).select("a", "b")


def linked(blocks: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the sets that have a link (see ``link_blocks``)."""
    return link_blocks(
        blocks, lambda left, right: _met(left, right, percent), lambda pairs: similar(pairs, segments, percent)
    )


def join_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    width: int = 4,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row; similar texts reach each other.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word
    shingles is ``percent`` hundredths or more. Equal sets are one class from the
    start, so copies are never paired. Sets whose lowest hashes show that they
    resemble no other are left out (``promising``). The others are put in the global order, rare shingles first. Sets meet under the first
    shingle that they share (``blocks_of``, ``linked``); the global order is cut
    into ``fragments``, each set's segments are laid side by side per fragment,
    and the partial overlaps of a pair are summed (``similar``).

    ``component_id`` is the smallest id that can be reached, itself included.
    Texts without words are linked with nothing. Rows without an id take part; on
    their own they have a null component. Rows that repeat an id have the
    component of their own text. An empty table gives an empty one; further
    columns are ignored.
    """
    kind = column_type(documents, id_column)
    rows = documents.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_txt"), F.col(text_column).alias("_text")
    )
    ddl = f"_id {kind}, _txt long, size long, digest binary, lowest array<long>"
    digested = rows.mapInArrow(_digested(width, percent), ddl).withColumn("row", F.monotonically_increasing_id())
    digested = stored(digested, "digests")
    classes = (
        digested.filter("size > 0")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("_id").alias("least"),
            F.min(F.struct("_txt", "_id")).alias("holder"),
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = stored(classes, "classes")
    holders = classes.join(promising(digested, percent), "digest", "left_semi").select("cid", "holder._txt", F.col("holder._id").alias("_held"))
    texts = rows.join(holders, "_txt").filter(F.col("_id").eqNullSafe(F.col("_held"))).select("cid", "_text")
    sets = stored(texts.mapInArrow(_gathered(width), "cid long, grams array<long>"), "sets")
    ordered = stored(ordered_sets(sets), "ordered")
    segments = stored(segments_of(ordered, borders_of(ordered, fragments)), "segments")
    found = linked(blocks_of(ordered, percent), segments, percent)

    named = classes.select("cid", "digest", "copies", "least").join(
        found.select(F.col("node").alias("cid"), "component"), "cid", "left"
    )
    grouped = named.filter("component is not null")
    leasts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = (
        grouped.join(leasts, "component")
        .select("digest", "component_id")
        .unionByName(
            named.filter("component is null and copies > 1").select("digest", F.col("least").alias("component_id"))
        )
    )
    return (
        digested.select("_id", "size", "digest")
        .join(answer, "digest", "left")
        .select(
            F.col("_id").alias(id_column),
            F.col("size").alias("n_shingles"),
            F.coalesce("component_id", "_id").alias("component_id"),
        )
    )
