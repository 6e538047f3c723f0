"""Chat rendering of maximal conversations: cumulative-snapshot collapse.

Logs hold snapshots of one conversation as it grew. Every turn gets the rolling hash of the turns
up to it; a conversation whose whole hash is the hash of a proper prefix of another one is a
snapshot, an anti-join drops it, and of identical conversations the smallest id stays. What is
left is rendered in ChatML. Built-in expressions only. The rolling hash is a pair of running sums
of 60-bit pieces of SHA-256(position, role, text), so it is computed over a range-dealt order and
a conversation of any length is split over tasks.

Defined cases: rows that repeat (conversation, turn, role, text) count once; several rows with one
turn number are ordered by the hash of role and text; turns are placed by rank, so gaps in the
numbers do not matter; a null turn comes first; rows without an id form one conversation of null
id; a null role is rendered as `unknown` and differs from that word; a null text is rendered empty
and differs from the empty text; an empty table gives no rows. A conversation of more than
`part_turns` turns is rendered in several rows, whose texts joined in order of `part` are the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_join, materialise, ordered, running_sums

#: Sums of 60-bit numbers: exact in decimal(38,0) for more rows than any table has.
_SUM = "decimal(38,0)"


def _keyed(turns: DataFrame) -> DataFrame:
    own = F.concat(F.coalesce(F.concat(F.lit("r"), F.col("role")), F.lit("n")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n")))
    return turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        F.col("conv_id").cast("long"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63)).cast("long")).alias("turn"),
        F.sha2(own, 256).alias("own"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, conv_id, turn, own, pos (from 0), n_turns and the rolling hash (a, b) of each distinct turn."""
    keyed = _keyed(turns).select("conv", "conv_id", "turn", "own").groupBy("conv", "turn", "own").agg(F.max("conv_id").alias("conv_id"))
    ranked = materialise(ordered(materialise(keyed, "chat-turns"), ["conv", "turn", "own"], "chat-order"), "chat-ranked")
    convs = materialise(ranked.groupBy("conv").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_turns")), "chat-lengths")
    placed = ranked.join(convs.hint("merge"), "conv").withColumn("pos", F.col("rank") - F.col("first"))
    mixed = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.col("own")), 256)
    placed = placed.withColumn("_mix", mixed)
    for name, at in (("a", 1), ("b", 16)):
        placed = placed.withColumn(name, F.conv(F.substring("_mix", at, 15), 16, 10).cast(_SUM))
    placed = placed.withColumn("va", F.col("a")).withColumn("vb", F.col("b")).drop("_mix", "first")
    sums = materialise(running_sums(materialise(placed, "chat-placed"), ["rank"], ["a", "b"], "chat-sums"), "chat-running")
    start = sums.where("pos = 0").select("conv", (F.col("a") - F.col("va")).cast(_SUM).alias("a0"), (F.col("b") - F.col("vb")).cast(_SUM).alias("b0"))
    start = materialise(start, "chat-starts")
    out = sums.join(start.hint("merge"), "conv")
    return out.select("conv", "conv_id", "turn", "own", "pos", "n_turns", (F.col("a") - F.col("a0")).cast(_SUM).alias("a"), (F.col("b") - F.col("b0")).cast(_SUM).alias("b"))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv of each conversation that no other one extends; of identical ones the smallest id's."""
    key = [F.col("pos") + 1, F.col("a"), F.col("b")]
    wholes = hashes.where(F.col("pos") == F.col("n_turns") - 1).groupBy(key[0].alias("k"), "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("conv"))).alias("_w"))
    inner = hashes.where(F.col("pos") < F.col("n_turns") - 1).groupBy(key[0].alias("k"), "a", "b").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return wholes.join(inner.hint("merge"), ["k", "a", "b"], "left_anti").select("_w.conv")


def format_chats(turns: DataFrame, part_turns: int = 4096) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), n_part_turns and text of the maximal conversations."""
    hashes = materialise(prefix_hashes(turns), "chat-hashes")
    stays = materialise(maximal(hashes), "chat-maximal")
    wanted = materialise(checked_join(hashes, stays, ["conv"]).select("conv", "turn", "own", "pos", "n_turns"), "chat-wanted")
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    texts = _keyed(turns).dropDuplicates(["conv", "turn", "own"]).join(wanted.hint("merge"), ["conv", "turn", "own"])
    part = F.expr(f"pos div {part_turns}L").cast("long")
    # at most part_turns turns meet in a group
    joined = texts.withColumn("line", line).groupBy("conv", part.alias("part")).agg(
        F.max("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_part_turns"),
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"),
    )
    text = F.concat_ws("", F.transform("lines", lambda x: x["line"]))
    return joined.select("conv_id", "part", "n_turns", "n_part_turns", text.alias("text"))
