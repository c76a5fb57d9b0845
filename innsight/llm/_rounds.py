"""Components of rows that meet in blocks, without comparing all pairs of a block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm._components import components
from innsight.llm._work import stored

#: A block of so many members is finished by comparing each with each, times the round's pivots.
SMALL_BLOCK = 8
#: By how much the pivots of a block grow from round to round.
MORE_PIVOTS = 4


def in_company(posted: DataFrame) -> DataFrame:
    """``posted`` under keys that have two members or more, with their number ``n``."""
    return posted.join(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")


def link_blocks(
    blocks: DataFrame,
    paired: Callable[[DataFrame, DataFrame], DataFrame],
    confirmed: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``node, component`` of the members that have a link.

    ``blocks`` has ``key, cid, weight`` and the columns that ``paired`` needs.
    ``paired`` gives the pairs, with their smaller id as ``a`` and the other as
    ``b``, of two sides of blocks that may be linked and differ in ``comp``;
    ``confirmed`` keeps those that are linked, as ``a, b``.

    Rounds, the same for every block. In each, some pivots of a block, those of
    the largest weight, are compared with all its members of other components,
    and links join components. A pivot is done with its block; a block whose
    members are one component is done, too. A block small enough for the round
    is finished with all pairs between its components. The pivots grow by a
    factor, so the rounds grow with the logarithm of the largest block; members
    that all resemble one text, however many, take one pair each.
    """
    live = in_company(blocks).withColumn("comp", F.col("cid"))
    live, known, pivots = stored(live, "blocks"), None, 1
    columns = [c for c in live.columns if c not in ("key", "n")]
    while True:
        few, many = live.filter(F.col("n") <= SMALL_BLOCK * pivots), live.filter(F.col("n") > SMALL_BLOCK * pivots)
        salt = F.pmod(F.xxhash64("cid"), F.lit(pivots)).alias("salt")
        first = F.max(F.struct("weight", *[c for c in columns if c != "weight"])).alias("p")
        chosen = stored(many.groupBy("key", salt).agg(first).select("key", "p.*"), "pivots")
        pairs = paired(few, few).unionByName(paired(chosen, many)).distinct()
        links = confirmed(stored(pairs, "pairs"))
        if known is not None:
            links = links.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        known = stored(components(links), "components")
        left = many.join(chosen.select("key", "cid"), ["key", "cid"], "left_anti")
        named = known.select(F.col("node").alias("cid"), F.col("component").alias("_now"))
        left = left.drop("n").join(named, "cid", "left").withColumn("comp", F.coalesce("_now", "comp")).drop("_now")
        left = stored(left, "left")
        open_blocks = left.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("comp").alias("_low"), F.max("comp").alias("_high")
        )
        live = stored(left.join(open_blocks.filter("_low <> _high").select("key", "n"), "key"), "blocks")
        if live.isEmpty():
            return known
        pivots *= MORE_PIVOTS
