"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._work import stored

#: Places on the ring. Keys of one place share their way around it.
RING_BITS = 16
#: Virtual nodes of each shard.
VIRTUAL_NODES = 1024


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in clockwise order: ``places[i]`` is held by ``owners[i]``."""

    shards: int
    places: tuple[int, ...]
    owners: tuple[int, ...]

    @staticmethod
    def of(shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> Ring:
        """A shard's virtual nodes depend on its number alone; on a taken place the next free one is used."""
        if shards * virtual_nodes > 1 << bits:
            raise ValueError("more virtual nodes than places on the ring")
        taken: dict[int, int] = {}
        for shard in range(shards):
            for node in range(virtual_nodes):
                digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
                place = int.from_bytes(digest, "big") >> (64 - bits)
                while place in taken:
                    place = (place + 1) % (1 << bits)
                taken[place] = shard
        places = tuple(sorted(taken))
        return Ring(shards, places, tuple(taken[p] for p in places))


def allot(ring: Ring, keys_at: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``place, rank_from, rank_to, shard, slot_from`` that spread ``keys_at`` over the shards.

    Each shard takes its share of all keys and no more: shares differ by one at
    most, the larger ones going to the lower shards. Going round the ring once,
    the keys of a place fill the shard of the next virtual node clockwise; those
    beyond its share go on to the next virtual node of a shard with room.
    """
    total = sum(keys_at.values())
    room = [total // ring.shards + (s < total % ring.shards) for s in range(ring.shards)]
    filled = [0] * ring.shards
    nodes = len(ring.places)
    following = list(range(nodes))  # of each node the next one, itself included, whose shard has room

    def with_room(node: int) -> int:
        path = []
        while True:
            if following[node] != node:
                path.append(node)
                node = following[node]
            elif filled[ring.owners[node]] >= room[ring.owners[node]]:
                following[node] = (node + 1) % nodes
            else:
                break
        for passed in path:
            following[passed] = node
        return node

    rows, node = [], 0
    for place in sorted(keys_at):
        while node < nodes and ring.places[node] < place:
            node += 1
        rank, left = 0, keys_at[place]
        while left:
            shard = ring.owners[with_room(node % nodes)]
            took = min(left, room[shard] - filled[shard])
            rows.append((place, rank, rank + took, shard, filled[shard]))
            filled[shard] += took
            rank, left = rank + took, left - took
    return rows


def shard_documents(
    documents: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """Shard and slot of every row: ``id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: with bounded loads at their tightest, the counts of any
    two shards differ by one at most. Keys (id and text) are hashed to places on
    the ring in Spark; what reaches the driver is the number of keys at each
    place, at most ``2 ** RING_BITS`` numbers however large the table, and what
    is broadcast back is their allotment, bounded by the same number plus one row
    per shard. No text is shuffled.

    ``size`` is the UTF-8 length plus one, null texts being empty. Equal rows are
    counted before they are numbered, so that copies of one row are one row in
    the shuffle; each still gets a slot of its own. Null ids are keys like any
    other. An empty table gives no rows. Further columns are ignored.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    keys = documents.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_point", F.xxhash64("_id", "text_crc32", "size"))
    keys = keys.withColumn("_place", F.shiftrightunsigned("_point", 64 - RING_BITS).cast("int"))
    keys = stored(keys.groupBy(keys.columns).agg(F.count(F.lit(1)).alias("_rows")), "shard-keys")

    ring = Ring.of(shards, virtual_nodes)
    at = {r["_place"]: r["n"] for r in keys.groupBy("_place").agg(F.sum("_rows").alias("n")).collect()}
    allotment = spark.createDataFrame(
        allot(ring, at), "place int, rank_from long, rank_to long, shard int, slot_from long"
    )
    ranks = (
        "sum(_rows) over (partition by _place order by _point, _id, text_crc32, size "
        "rows between unbounded preceding and current row)"
    )
    ranked = (
        keys.withColumn("_end", F.expr(ranks))
        .withColumn("_rank", F.explode(F.sequence(F.col("_end") - F.col("_rows"), F.col("_end") - 1)))
        .drop("_end", "_rows")
    )
    here = (
        (F.col("_place") == F.col("place"))
        & (F.col("_rank") >= F.col("rank_from"))
        & (F.col("_rank") < F.col("rank_to"))
    )
    return ranked.join(F.broadcast(allotment), here).select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot_from") + F.col("_rank") - F.col("rank_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
