"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A service that logs a conversation after every turn leaves one log per turn,
each a prefix of the next. A turn is first reduced to two hashes of its role and
text; the rolling hash of a prefix is the sum of the hashes of (position, turn)
of its turns, in four words of 32 bits, which extends by one addition and is
therefore a running sum in two levels. A conversation whose last hash is
another's hash before its end is a prefix of it: an anti-join drops those, and
all but the first of equal ones. Until then only hashes travel; texts are
shuffled once, those of the conversations that are kept, and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import durable

#: Turns of a conversation in one piece of its running sums.
PIECE = 512


def _part(turn: Column) -> Column:
    """The piece of a turn number: monotone, and null before all others."""
    return F.coalesce(F.shiftright(turn.cast("long"), 9), F.lit(-(1 << 62)))


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _settle_ties(numbered: DataFrame, turns: DataFrame) -> DataFrame:
    """Put turns with equal numbers in the order of role, then text, for which alone their texts are read again."""
    same = numbered.where("tie").select("conv_id", "part", "turn").distinct()
    first = numbered.join(same.select(*(F.col(c).alias(f"_{c}") for c in same.columns)), (F.col("conv_id") == F.col("_conv_id")) & (F.col("part") == F.col("_part")) & F.col("turn").eqNullSafe(F.col("_turn")))
    first = first.groupBy("_conv_id", "_part", "_turn").agg(F.min("at").alias("_first"))
    texts = turns.select("conv_id", "turn", "role", "text", _part(F.col("turn")).alias("part")).join(first, (F.col("conv_id") == F.col("_conv_id")) & (F.col("part") == F.col("_part")) & F.col("turn").eqNullSafe(F.col("_turn")))
    texts = texts.select("_conv_id", "_part", "_turn", "_first", "role", "text", _turn_hash(1).alias("_t1"), _turn_hash(2).alias("_t2")).distinct()
    nth = F.row_number().over(Window.partitionBy("_conv_id", "_part", "_turn").orderBy("role", "text")) - 1
    ranked = texts.select("_conv_id", "_part", "_turn", "_t1", "_t2", (F.col("_first") + nth).alias("_at"))
    on = (F.col("conv_id") == F.col("_conv_id")) & (F.col("part") == F.col("_part")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    return numbered.join(ranked, on, "left").select("conv_id", "part", "turn", "t1", "t2", F.coalesce("_at", "at").alias("at"))


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns, pos, p1, p2), per turn its position from 0 and the two hashes of the prefix that ends with it; and (conv_id, part), the pieces."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", _part(F.col("turn")).alias("part"), _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    # One exchange serves the removal of repeated rows and the numbering.
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "t1", "t2")
    at, before = F.row_number().over(inside) - 1, F.lag("turn").over(inside)
    numbered = rows.repartition("conv_id", "part").distinct().select("*", at.cast("long").alias("at"), before.eqNullSafe(F.col("turn")).alias("same"))
    numbered = durable(numbered.select("conv_id", "part", "turn", "t1", "t2", "at", (F.col("same") & (F.col("at") > 0)).alias("tie")))
    if numbered.where("tie").limit(1).count():
        numbered = durable(_settle_ties(numbered, turns))
    # Totals of the pieces give each piece's shift; a conversation's turns never gather in one task.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    on = (F.col("conv_id") == F.col("_conv_id")) & (F.col("part") == F.col("_part"))
    placed = numbered.join(sizes, on).select("conv_id", "part", "n_turns", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2")
    a, b, low = F.xxhash64(F.lit(1), "pos", "t1", "t2"), F.xxhash64(F.lit(2), "pos", "t1", "t2"), F.lit(0xFFFFFFFF)
    words = {"w0": a.bitwiseAND(low), "w1": F.shiftrightunsigned(a, 32), "w2": b.bitwiseAND(low), "w3": F.shiftrightunsigned(b, 32)}
    hashed = placed.select("conv_id", "part", "n_turns", "pos", *(h.alias(w) for w, h in words.items()))
    totals = hashed.groupBy("conv_id", "part").agg(*(F.sum(w).alias(w) for w in words))
    totals = totals.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), *(F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_{w}") for w in words))
    upto = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv_id", "part", "n_turns", "pos", *(F.sum(w).over(upto).alias(w) for w in words)).join(totals, on)
    sums = [F.col(w) + F.col(f"_{w}") for w in words]
    out = summed.select("conv_id", "n_turns", "pos", F.xxhash64(F.lit(1), *sums).alias("p1"), F.xxhash64(F.lit(2), *sums).alias("p2"))
    return out, numbered.select("conv_id", "part").distinct()


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): every conversation that is kept.

    `copies` conversations have exactly these turns; the one with the smallest id
    stands for them. An empty table gives an empty one.
    """
    whole = hashes.where("pos = n_turns - 1").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # What some conversation has before its end: each prefix once, however many conversations begin with it.
    inner = hashes.where("pos < n_turns - 1").select(F.col("pos").alias("_pos"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).distinct()
    on = (F.col("pos") == F.col("_pos")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2"))
    return whole.join(inner, on, "left_anti").select("conv_id", (F.col("pos") + 1).alias("n_turns"), "copies")


def format_chats(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, rendered): the maximal conversations as one text each.

    A turn renders as start + role + newline + text + end + newline, in order of
    turn (null first), then role, then text where turns tie. Rows that are
    repeated exactly count once; a null role or text renders as empty but differs
    from an empty one in comparisons; rows without conv_id belong to no
    conversation and are dropped; extra columns are ignored, whatever their names; an empty table gives
    an empty one; texts of any length are hashed and rendered whole. A rendered conversation is one value, so it alone, not what
    the operator gathers besides, is as long as its conversation.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    hashes, parts = prefixes(turns)
    kept = maximal(durable(hashes)).withColumnRenamed("conv_id", "_id")
    pieces = parts.join(kept, F.col("conv_id") == F.col("_id"))
    several = F.count("*").over(Window.partitionBy("conv_id"))
    pieces = durable(pieces.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), "n_turns", "copies", several.alias("pieces")))
    # Texts are shuffled once, by conversation and piece; the pieces of long conversations meet as finished texts only.
    piece = lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(end + "\n"))
    render = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))), piece), "")
    keyed = turns.withColumn("part", _part(F.col("turn")))

    def rendered(some: DataFrame) -> DataFrame:
        met = keyed.join(some, (F.col("conv_id") == F.col("_conv_id")) & (F.col("part") == F.col("_part")))
        return met.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), render.alias("rendered"))

    out = rendered(pieces.where("pieces = 1")).select("conv_id", "n_turns", "copies", "rendered")
    if pieces.where("pieces > 1").limit(1).count():
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "rendered"))), lambda x: x["rendered"]), "")
        out = out.unionByName(rendered(pieces.where("pieces > 1")).groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), joined.alias("rendered")))
    return out
