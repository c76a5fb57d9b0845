"""Chat formatting of logged conversations, cumulative snapshots collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm._work import stored

#: Turns rendered into one row; a longer conversation has several, numbered.
SEGMENT_TURNS = 128


def positioned(turns: DataFrame) -> DataFrame:
    """``conv, pos, h1, h2`` of ``turns(conv, turn, role, text)``: place in the conversation and two hashes.

    Turns are range-partitioned by conversation and turn, so that a conversation
    of very many turns spreads over many ranges; places are counted within a
    range and moved by the turns of the conversation in earlier ranges.
    """
    order = ["turn", "h1", "h2"]
    hashed = turns.select(
        "conv", "turn", F.xxhash64("role", "text", F.lit(1)).alias("h1"), F.xxhash64("text", "role", F.lit(2)).alias("h2")
    )
    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = stored(
        hashed.repartitionByRange(ranges, "conv", *order).withColumn("chunk", F.spark_partition_id()), "turns"
    )
    sizes = chunked.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("conv", "chunk").orderBy(*order)
    placed = chunked.withColumn("own", F.row_number().over(local))
    return placed.alias("p").join(
        starts.alias("s"), F.col("p.conv").eqNullSafe(F.col("s.conv")) & (F.col("p.chunk") == F.col("s.chunk"))
    ).select("p.conv", "p.chunk", (F.col("start") + F.col("own")).alias("pos"), "p.turn", "h1", "h2")


def prefixes(placed: DataFrame) -> DataFrame:
    """``conv, pos, d1, d2``: rolling hash of the first ``pos`` turns, two times 64 bits.

    Each turn adds hashes of its place and content, cut in halves so that the
    sums stay exact; sums are taken within a range and moved by those of earlier
    ranges.
    """
    halves = []
    for name, seed in (("x", 1), ("y", 2)):
        mixed = F.xxhash64("pos", "h1", "h2", F.lit(seed))
        halves += [(f"{name}h", F.shiftrightunsigned(mixed, 32)), (f"{name}l", mixed.bitwiseAND(F.lit(0xFFFFFFFF)))]
    terms = placed.select("conv", "chunk", "pos", *(e.alias(n) for n, e in halves))
    names = [n for n, _ in halves]
    sums = terms.groupBy("conv", "chunk").agg(*(F.sum(n).alias(n) for n in names))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "chunk", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"c{n}") for n in names))
    upto = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = terms.select("conv", "chunk", "pos", *(F.sum(n).over(upto).alias(n) for n in names))
    joined = own.alias("o").join(
        carried.alias("c"), F.col("o.conv").eqNullSafe(F.col("c.conv")) & (F.col("o.chunk") == F.col("c.chunk"))
    )
    total = [F.col(n) + F.col(f"c{n}") for n in names]
    return joined.select(
        "o.conv", "pos", F.xxhash64(total[0], total[1]).alias("d1"), F.xxhash64(total[2], total[3]).alias("d2")
    )


def maximal(prefix_hashes: DataFrame) -> DataFrame:
    """``conv, n_turns, n_snapshots``: the conversations that no other one continues.

    Of equal conversations the one with the smallest id stays; ``n_snapshots``
    counts the equal ones, itself included. Hashes of prefixes are made distinct
    before the anti-join, so a greeting that opens a third of all conversations
    is one row in it.
    """
    ends = prefix_hashes.groupBy("conv").agg(F.max("pos").alias("n_turns"))
    ended = prefix_hashes.alias("p").join(ends.alias("e"), F.col("p.conv").eqNullSafe(F.col("e.conv")))
    whole = (
        ended.filter(F.col("pos") == F.col("n_turns"))
        .groupBy("pos", "d1", "d2")
        .agg(F.min("p.conv").alias("conv"), F.count(F.lit(1)).alias("n_snapshots"))
    )
    begun = ended.filter(F.col("pos") < F.col("n_turns")).select("pos", "d1", "d2").distinct()
    return whole.join(begun, ["pos", "d1", "d2"], "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_snapshots")


def format_chats(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """``conv, segment, n_turns, n_snapshots, segment_turns, text`` of the maximal conversations.

    A conversation that is a turn-by-turn prefix of a longer one is a snapshot of
    it and is left out; of equal ones one stays. Prefixes are recognised by
    rolling hashes of role and text (128 bits), never by joining texts. A
    conversation is rendered as ``<|im_start|>role``, line feed, text,
    ``<|im_end|>``, line feed for each turn; every ``segment_turns`` turns make a
    row, so a conversation of ordinary length is one row and one of any length
    never meets in one task.

    Turns are ordered by turn, null first, then by a hash of their content; equal
    turns in one place stay both. Null roles and texts render as empty and differ
    from empty ones in the hash of their turn only by their null. Rows of a null
    conversation id are one conversation. An empty table gives none; further
    columns are ignored.
    """
    turns = conversations.select(
        F.col(conv_column).alias("conv"),
        F.col(turn_column).alias("turn"),
        F.col(role_column).alias("role"),
        F.col(text_column).alias("text"),
    )
    placed = stored(positioned(turns), "placed")
    kept = stored(maximal(prefixes(placed)), "maximal")
    with_hash = turns.withColumns(
        {"h1": F.xxhash64("role", "text", F.lit(1)), "h2": F.xxhash64("text", "role", F.lit(2))}
    )
    # equal turns in one place have places of their own: each text is needed once
    texts = with_hash.groupBy("conv", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    stays = placed.alias("p").join(kept.alias("k"), F.col("p.conv").eqNullSafe(F.col("k.conv"))).select(
        "p.conv", "p.turn", "p.h1", "p.h2", "pos", "n_turns", "n_snapshots"
    )
    full = stays.alias("s").join(
        texts.alias("t"),
        F.col("s.conv").eqNullSafe(F.col("t.conv"))
        & F.col("s.turn").eqNullSafe(F.col("t.turn"))
        & (F.col("s.h1") == F.col("t.h1"))
        & (F.col("s.h2") == F.col("t.h2")),
    )
    line = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    parts = full.select(
        F.col("s.conv").alias("conv"), "pos", "n_turns", "n_snapshots", F.expr(f"(pos - 1) div {segment_turns}").alias("segment"), line.alias("line")
    )
    rendered = parts.groupBy("conv", "segment").agg(
        F.first("n_turns").cast("long").alias("n_turns"),
        F.first("n_snapshots").alias("n_snapshots"),
        F.count(F.lit(1)).alias("segment_turns"),
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"),
    )
    return rendered.select(
        F.col("conv").alias(conv_column),
        "segment",
        "n_turns",
        "n_snapshots",
        "segment_turns",
        F.array_join(F.col("lines.line"), "").alias("text"),
    )
