"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in an order shuffled by hash, form a stream of words
that may be repeated up to twice. The golden-ratio points frac(i / phi) are
mapped through the sources' cumulative target shares: point i gives slot i to a
source, and a source's k slots take k equal-token blocks of its stream, which
end exactly at its target. So any run of slots mixes the sources close to their
weights, and each source's words are its target to within one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import disguised, durable, n_words_of, row_keys, running_sums

#: The fraction of the golden ratio in steps of 2^-31: multiples of it, mod 2^31, are the points.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Cells of the unit interval in which points meet the sources' intervals by an equi-join.
CELLS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source (source, source_size): source_no, weight, target.

    Targets are in proportion to the weights and sum to `share` of all sizes,
    but none exceeds `most` times its source's size; the excess is shared again
    by weight. That fixed point is found in one sort: with the sources in order
    of cap / weight, the first j are capped, where j is the least number for which
    the level (rest of the sum) / (rest of the weights) stays below the next cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    leveled = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    found = leveled.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy()))
    return found.select("source", "source_no", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def schedule(goals: DataFrame, spark, total: int, block: int) -> DataFrame:
    """(source_no, rank, slot, start, end): slot i's source and the words of its stream that it takes.

    `goals` has source_no and goal (whole words). Every source with a goal has a
    slot: its first lies at the start of its interval if no point falls there.
    """
    n = max(1, -(-total // block))
    wide = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    shares = goals.where("goal > 0").select(
        "source_no", "goal",
        (F.coalesce(F.sum("goal").over(wide), F.lit(0)).cast("double") / F.sum("goal").over(every)).alias("lo"),
        ((F.coalesce(F.sum("goal").over(wide), F.lit(0)) + F.col("goal")).cast("double") / F.sum("goal").over(every)).alias("hi"),
    )
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(n).select(F.col("id").alias("slot"), (((F.col("id") + 1) % POINTS * GOLDEN % POINTS).cast("double") / POINTS).alias("x")).withColumn("cell", cell(F.col("x")))
    hit = points.join(cells, "cell").where("x >= lo AND x < hi").select("source_no", "goal", "slot")
    missed = shares.join(hit.select("source_no").distinct(), "source_no", "left_anti").select("source_no", "goal", F.lit(-1).cast("long").alias("slot"))
    slots = hit.unionByName(missed).select("*", F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / 65536).alias("part"))
    ranked = running_sums(durable(slots), ["source_no"], "part", ["slot"], {"rank": "one"})
    counts = ranked.groupBy("source_no").agg(F.count("*").alias("k")).withColumnRenamed("source_no", "_no")
    return ranked.join(counts, F.col("source_no") == F.col("_no")).select("source_no", "rank", "slot", "goal", "k", _cut(F.col("rank")).alias("start"), _cut(F.col("rank") + 1).alias("end"))


def _cut(rank: Column) -> Column:
    """floor(rank * goal / k) in whole numbers: where a source's slot number `rank` starts."""
    q, r = F.expr("goal div k"), F.expr("goal % k")
    return rank * q + F.call_function("div", rank * r, F.col("k"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, block: int = 8192, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per row of docs: row_id, doc_id, k1, k2, source, size, source_size, target, taken, starts; pieces of the schedule).

    `taken` counts the words of the row in the mix, repeats included, at most
    twice its size; `starts` how often its first word is in it. The pieces are
    (row_id, source_no, slot, first, length): the words of a row that a slot
    takes; k1 and k2 stand for id, source and text. Null texts have size 0 and are never taken; a null source
    is a source of its own, the last; repeated rows are rows of their own, next
    to each other in the shuffled order; ties in the hash are broken by id and
    those; empty tables give empty results; texts of any length count whole; other
    columns are ignored, whatever their names. The sources themselves are ranked in one
    task, as a schedule over all of them needs: a row per source, which suits up to some millions.
    """
    spark = docs.sparkSession
    k1, k2 = row_keys("doc_id", "source", "text")
    sized = durable(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2"), F.xxhash64(F.lit(seed), k1, k2).alias("h")))
    goals = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    n_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goals = goals.withColumn("goal", F.floor(F.col("target") + 1e-6).cast("long"))
    slots = schedule(goals, spark, int(total * share), block)

    parts = max(1, -(-n_rows // 4_000))
    keyed = sized.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("part", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts).cast("long"))
    placed = durable(running_sums(keyed, ["source_no"], "part", ["h", "doc_id", "k1", "k2"], {"place": "size"}).withColumn("row_id", F.monotonically_increasing_id()))

    # The words [place, place + size) of the stream, again one round later; cut at the goal.
    turns = placed.where("size > 0").select("row_id", "source_no", "goal", "size", F.explode(F.array(F.col("place"), F.col("place") + F.col("source_size"))).alias("at")).where("at < goal")
    counts = slots.groupBy("source_no").agg(F.max("k").alias("k")).withColumnRenamed("source_no", "_no")
    known = turns.join(counts, F.col("source_no") == F.col("_no")).drop("_no")
    known = known.withColumn("to", F.least(F.col("at") + F.col("size"), F.col("goal")))
    # Slot r covers [floor(r * goal / k), floor((r + 1) * goal / k)): those that meet [at, to), one to each side to be safe.
    near = lambda x: F.floor(x.cast("double") * F.col("k") / F.col("goal")).cast("long")
    pieces = known.withColumn("rank", F.explode(F.sequence(F.greatest(near(F.col("at")) - 1, F.lit(0)), F.least(near(F.col("to")) + 1, F.col("k") - 1))))
    s = slots.select(F.col("source_no").alias("_no"), F.col("rank").alias("_rank"), "slot", "start", "end")
    cut = (
        pieces.where((_cut(F.col("rank")) < F.col("to")) & (_cut(F.col("rank") + 1) > F.col("at")))
        .join(s, (F.col("source_no") == F.col("_no")) & (F.col("rank") == F.col("_rank")))
        .select("row_id", "source_no", "slot", (F.greatest("at", "start") - F.col("at")).alias("first"), (F.least("to", "end") - F.greatest("at", "start")).alias("length"))
        .where("length > 0")
    )
    taken = cut.groupBy("row_id").agg(F.sum("length").alias("taken"), F.sum(F.when(F.col("first") == 0, 1).otherwise(0)).alias("starts"))
    rows = placed.join(taken.withColumnRenamed("row_id", "_row"), F.col("row_id") == F.col("_row"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("row_id", "doc_id", "k1", "k2", "source", "size", "source_size", "target", zero("taken"), zero("starts")), cut


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The whole documents of the mix with all columns of `docs` as they are, whatever their names: each as often as the mix begins it (0, 1 or 2 times).

    Decisions are joined by a hash of id, source and text; rows that are equal
    in these share their copies, the first of them the odd ones. The window that
    numbers them uses the join's own partitions and order. Null and blank texts
    have no words and are not in the mix; an empty table gives an empty one.
    """
    rows, _ = mix(docs, **options)
    wanted = rows.groupBy("k1", "k2").agg(F.sum("starts").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    plain, name = disguised(docs)
    k1, k2 = row_keys(*(name[c] for c in ("doc_id", "source", "text")))
    joined = plain.withColumns({"_1": k1, "_2": k2}).join(wanted, (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2")))
    nth = F.row_number().over(Window.partitionBy("_1", "_2").orderBy("_1"))
    copies = F.expr("cast(_copies div _rows + if(_nth <= _copies % _rows, 1, 0) as int)")
    each = F.explode(F.expr("sequence(1, _own)"))
    return joined.withColumn("_nth", nth).withColumn("_own", copies).where("_own > 0").withColumn("_copy", each).select(*plain.columns).toDF(*docs.columns)
