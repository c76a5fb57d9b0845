"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._components import components
from innsight.llm._work import column_type, slices, stored

#: Coordinates of a signature, and how many must agree. Two sets of similarity
#: 0.85 agree in fewer than 40 of 64 with a probability of about 1e-6.
COORDINATES, LEAST_AGREEING = 64, 40
#: A block of so many members is compared pair by pair.
SMALL_BLOCK = 16
#: Shingles and members of a chunk of a large block; two chunks meet in one task,
#: whose matrices of pairs then take some 100 MB.
CHUNK_SHINGLES, CHUNK_MEMBERS = 50_000, 750

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers in place."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of the whole text.

    A-Z are lower-cased; words are runs without blank, tab, line feed, vertical
    tab, form feed and carriage return. A text of fewer words is one shingle; one
    without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    joined = single[:n].copy()
    for i in range(1, width):
        joined *= _U(0x9E3779B97F4A7C15)
        joined += single[i : i + n]
        joined ^= joined >> _U(31)
    return np.unique(_mixed(joined))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """For each of as many hash functions the smallest value over the shingles, as signed 32-bit numbers."""
    seeds = _mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    low = np.full(coordinates, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = _mixed(shingles[None, at : at + 4096] ^ seeds[:, None])
        low = np.minimum(low, x.min(1) >> _U(32))
    return low.astype(np.uint32).view(np.int32)


def _identified(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_txt"), F.col(text_column).alias("_text")
    )


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _signed(coordinates: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, digests, signatures = [], [], []
            for text in part.column(2).to_pylist():
                found = shingle_hashes(text, width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found, coordinates) if len(found) else np.empty(0, np.int32))
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(signatures, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *arrays], ["_id", "_txt", "size", "digest", "sig"]
            )

    return sign


def _shingled(width: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            found = [shingle_hashes(t, width).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pa.int64())], ["cid", "shingles"])

    return shingle


def blocks_of(classes: DataFrame, coordinates: int, agreeing: int) -> DataFrame:
    """Postings ``key, cid, weight`` under which any two classes that agree often enough meet.

    ``key`` is a coordinate with its value. Values that only one class has can't
    agree with anything: a class with fewer than ``agreeing`` shared ones is out.
    Ordered from rare to frequent, two classes that agree in ``agreeing`` of
    ``coordinates`` share one of their first ``coordinates - agreeing + 1``, and
    a class's unshared ones come first in that order; so a class is posted only
    under the rarest of its shared values. ``weight`` is the sum of its values'
    frequencies: large for the text that many others were made from.
    """
    posted = classes.select("cid", F.posexplode("sig").alias("at", "value")).select(
        "cid", F.expr("shiftleft(cast(at as long), 32) + (cast(value as long) & 4294967295)").alias("key")
    )
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = (
        posted.join(shared, "key")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"), F.sum("n").alias("weight"))
        .filter(F.size("found") >= agreeing)
    )
    prefix = lists.select(
        "cid", "weight", F.explode(F.slice("found", F.lit(1), F.size("found") - (agreeing - 1))).alias("p")
    ).select(F.col("p.key").alias("key"), "cid", "weight")
    return prefix


def rarest_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Postings ``key, cid`` under the rarest shingles of each class; similar enough sets share one of them.

    Of two sets with a similarity of ``percent`` hundredths each holds so many
    hundredths of the other, so leaving out the most frequent of that share still
    leaves one in common. Shingles that one class alone has come first in the
    order and are not posted.
    """
    single = sets.select("cid", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    shared = single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = (
        single.join(shared, "key")
        .groupBy("cid", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))
        .withColumn("posts", F.size("found") - F.expr(f"(size * {percent} + 99) div 100") + 1)
        .filter("posts > 0")
    )
    return lists.select("cid", F.explode(F.slice("found", F.lit(1), F.col("posts").cast("int"))).alias("p")).select(
        F.col("p.key").alias("key"), "cid"
    )


def _in_company(blocks: DataFrame) -> DataFrame:
    """Blocks with two members or more, with their number ``n``."""
    return blocks.join(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")


def _alike(pairs: DataFrame, classes: DataFrame, sets: DataFrame, agreeing: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose signatures agree often enough and whose full sets are similar enough."""
    sig = classes.select("cid", "sig")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    counted = (
        pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
        .filter(agree >= agreeing)
        .select("a", "b")
    )
    common = F.size(F.array_intersect("xa", "xb"))
    return (
        counted.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb")), "b")
        .filter(100 * common >= percent * (F.size("xa") + F.size("xb") - common))
        .select("a", "b")
    )


def tile_links(comps: list[int], sets: list[np.ndarray], percent: int, columns: int = 2048) -> list[tuple[int, int]]:
    """Links between sets of different components, as few as join all that are linked."""
    parent = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if len(parent) < 2:
        return []
    n, lengths = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), lengths)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    numbered = np.cumsum(shared) - 1
    good = shared[place]
    owner, place = owner[good], numbered[place[good]]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(shared.sum()), columns):
        here = (place >= at) & (place < at + columns)
        part = np.zeros((n, columns), np.float32)
        part[owner[here], place[here] - at] = 1
        common += part @ part.T
    links = []
    for a in range(n - 1):
        shared_with = common[a, a + 1 :]
        for b in np.flatnonzero(100 * shared_with >= percent * (lengths[a] + lengths[a + 1 :] - shared_with)) + a + 1:
            ca, cb = root(comps[a]), root(comps[b])
            if ca != cb:
                parent[ca] = cb
                links.append((a, int(b)))
    return links


def _tile(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        cids, comps = table.column("cid").to_pylist(), table.column("comp").to_pylist()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        links = tile_links(comps, sets, percent)
        return pa.Table.from_arrays([pa.array([cids[x[k]] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return compare


def _linked(blocks: DataFrame, classes: DataFrame, sets: DataFrame, agreeing: int, percent: int) -> DataFrame:
    """``node, component`` of the classes that have a link.

    All pairs of a small block are compared. The members of larger ones are
    posted once more, under their rarest shingles, and of these blocks again the
    small ones are compared pair by pair. In a large one a pivot, the member that
    shares most with others, is compared with all; where that leaves more than
    one component, the rest of the block is cut into chunks and each two chunks
    meet in one task of bounded size, which gives only the links that join
    components. So every link is found or lies inside a component, and no more
    rows leave a block than tasks times members.
    """
    near = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")

    def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select("key", F.col("cid").alias("a"), F.col("size").alias("sa"))
        b = right.select("key", F.col("cid").alias("b"), F.col("size").alias("sb"))
        return a.join(b, "key").filter(near).select("a", "b")

    small = blocks.filter(F.col("n") <= SMALL_BLOCK)
    crowd = blocks.filter(F.col("n") > SMALL_BLOCK).groupBy("cid").agg(F.first("size").alias("size"), F.first("weight").alias("weight"))
    crowd = stored(crowd, "crowd")
    finer = _in_company(rarest_shingles(sets.join(crowd, "cid", "left_semi"), percent)).join(crowd, "cid")
    finer = stored(finer, "finer-blocks")
    fine, large = finer.filter(F.col("n") <= SMALL_BLOCK), finer.filter(F.col("n") > SMALL_BLOCK)
    pivots = large.groupBy("key").agg(F.max(F.struct("weight", "cid", "size")).alias("p")).select("key", "p.cid", "p.size")
    pivots = stored(pivots, "pivots")
    pairs = crossed(small, small).filter("a < b").unionByName(crossed(fine, fine).filter("a < b"))
    pairs = pairs.unionByName(crossed(pivots, large).filter("a <> b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _alike(stored(pairs, "pairs"), classes, sets, agreeing, percent)
    found = stored(components(links), "components")

    names = found.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    rest = (
        large.join(pivots.select("key", "cid"), ["key", "cid"], "left_anti")
        .join(names, "cid", "left")
        .select("key", "cid", "size", F.coalesce("comp", "cid").alias("comp"))
    )
    undone = (
        rest.groupBy("key")
        .agg(
            F.min("comp").alias("l"), F.max("comp").alias("h"),
            F.sum("size").alias("all"), F.count(F.lit(1)).alias("members"),
        )
        .filter("l <> h")
        .select("key", F.ceil(F.greatest(F.col("all") / CHUNK_SHINGLES, F.col("members") / CHUNK_MEMBERS)).alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks"))
    tiled = (
        rest.join(undone, "key")
        .withColumn("own", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("key", "cid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(sets, "cid")
    )
    more = tiled.groupBy("key", "i", "j").applyInArrow(_tile(percent), "a long, b long")
    kept = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(more.unionByName(kept))


def _judged(
    documents: DataFrame, id_column: str, text_column: str, percent: int, width: int, coordinates: int, agreeing: int
) -> DataFrame:
    """``_id, _txt, size, component_id, joint`` of every row; ``joint`` names its component, null if it is alone in it."""
    kind = column_type(documents, id_column)
    rows = _identified(documents, id_column, text_column)
    signed = stored(
        rows.mapInArrow(
            _signed(coordinates, width), f"_id {kind}, _txt long, size long, digest binary, sig array<int>"
        ),
        "signatures",
    )
    classes = stored(
        signed.filter("size > 0")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("_id").alias("least"),
            F.min(F.struct("_txt", "_id")).alias("holder"),
            F.first("size").alias("size"),
            F.first("sig").alias("sig"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    posted = _in_company(blocks_of(classes, coordinates, agreeing)).join(classes.select("cid", "size"), "cid")
    blocks = stored(posted, "blocks")
    met = blocks.select("cid").distinct()
    holders = classes.join(met, "cid", "left_semi").select("cid", "holder._txt", F.col("holder._id").alias("_held"))
    texts = rows.join(holders, "_txt").filter(F.col("_id").eqNullSafe(F.col("_held"))).select("cid", "_text")
    sets = texts.mapInArrow(_shingled(width), "cid long, shingles array<long>")
    sets = stored(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")
    found = _linked(blocks, classes, sets, agreeing, percent)

    named = classes.select("cid", "digest", "copies", "least").join(
        found.withColumnRenamed("node", "cid").withColumnRenamed("component", "comp"), "cid", "left"
    )
    grouped = named.filter("comp is not null")
    leasts = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    answer = (
        grouped.join(leasts, "comp")
        .select("digest", "component_id", F.col("comp").alias("joint"))
        .unionByName(
            named.filter("comp is null and copies > 1").select(
                "digest", F.col("least").alias("component_id"), F.col("cid").alias("joint")
            )
        )
    )
    return signed.select("_id", "_txt", "size", "digest").join(answer, "digest", "left").drop("digest")


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    width: int = 5,
    coordinates: int = COORDINATES,
    agreeing: int = LEAST_AGREEING,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    Documents are linked if the Jaccard similarity of their shingle sets is
    ``percent`` hundredths or more. Equal sets are one class from the start, so
    copies are never paired. Classes meet through the inverted index of their
    signature coordinates (see ``blocks_of`` and ``_linked``). Pairs that agree in
    ``agreeing`` coordinates are confirmed on the full sets.

    ``component_id`` is the smallest id that can be reached, ``kept`` marks its
    row. Texts without words are linked with nothing. Rows without an id take
    part and are not kept if anything they are linked with has one; on their own
    they are kept with a null component. Rows that repeat an id share its
    verdict. An empty table gives none; further columns are ignored.
    """
    out = _judged(documents, id_column, text_column, percent, width, coordinates, agreeing)
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_column),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, component.isNull()).alias("kept"),
    )


def one_of_each(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    width: int = 5,
    coordinates: int = COORDINATES,
    agreeing: int = LEAST_AGREEING,
) -> DataFrame:
    """``documents`` with one row of each group of linked ones, in all its columns.

    The row with the smallest id stays, one without an id only if no other has
    one, and of one id's texts the one with the smallest hash. Rows with equal
    id and text are one document, of which one row stays. Rows without words
    are linked with nothing.
    """
    judged = stored(_judged(documents, id_column, text_column, percent, width, coordinates, agreeing), "judged")
    place = F.struct(F.col("_id").isNull().alias("n"), "_id", "_txt")
    first = judged.filter("joint is not null").groupBy("joint").agg(F.min(place).alias("first"))
    gone = judged.join(first, "joint").filter(~place.eqNullSafe(F.col("first")))
    gone = gone.select(F.col("_id").alias("_key"), "_txt", F.lit(True).alias("_gone")).distinct()
    # documents and marks of those that go meet in one shuffle, which also unites repeated rows
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(documents.columns)]
    rows = documents.select(F.col(id_column).alias("_key"), F.xxhash64(text_column).alias("_txt"), F.struct(*columns).alias("_row"))
    met = rows.unionByName(gone, allowMissingColumns=True).groupBy("_key", "_txt")
    left = met.agg(F.max("_gone").alias("_gone"), F.min("_row").alias("_row")).filter("_gone is null")
    return left.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(documents.columns)])
