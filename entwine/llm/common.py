"""What the corpus operators share: durable intermediate tables, running sums in
two levels, connected components, and numpy helpers for block-wise comparison."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: What separates words in every operator: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders made for sessions on one machine, by application.
_made: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data, `spark.checkpoint.dir`.

    Only on one machine (a local master, as in tests) a temporary folder stands
    in for it; elsewhere other executors could not see that, so it is an error.
    """
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _made:
        _made[sc.applicationId] = tempfile.mkdtemp(prefix="entwine-scratch-")
    return _made[sc.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the cluster's shared folder and read them from there.

    Unlike a checkpoint such a table is compressed, is read column by column,
    and has a known size, by which Spark chooses its joins.
    """
    path = f"{scratch(df.sparkSession)}/entwine-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def disguised(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns named c0, c1, ... and what each name has become: working columns can't clash with any."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), {n: f"c{i}" for i, n in enumerate(docs.columns)}


def words_of(text: Column) -> Column:
    """The array of a text's words; empty for null and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def n_words_of(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def row_keys(*names: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a row's values, nulls included: equal rows have equal ones, and never null."""
    parts = [p for n in names for p in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)


def running_sums(df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add exclusive running sums of columns per key, without one task per key.

    `chunk` splits a key's rows into ranges of the order: all rows of a lower
    chunk come before those of a higher one. Rows are summed inside (key, chunk)
    and shifted by the totals of the chunks before, so a key with a third of
    all rows is spread over as many tasks as it has chunks. `sums`: new column
    -> summed column. Keys must not be null.
    """
    by = [*keys, chunk]
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by).agg(*(F.sum(v).alias(f"{k}_total") for k, v in sums.items()))
    shifts = totals.select(*by, *(F.coalesce(F.sum(f"{k}_total").over(before), F.lit(0)).alias(f"{k}_shift") for k in sums))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()))
    shifts = shifts.select(*(F.col(c).alias(f"_{c}") for c in by), *(f"{k}_shift" for k in sums))
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    out = local.join(shifts, on)
    return out.withColumns({k: F.col(k) + F.col(f"{k}_shift") for k in sums}).drop(*(f"_{c}" for c in by), *(f"{k}_shift" for k in sums))


def connected_components(edges: DataFrame, rounds: int = 60, places: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable from each end of the edges (a, b).

    Alternates large-star and small-star steps until the edge set no longer
    changes: every step is two aggregations and a join of edges, whose number
    never grows. Hubs, the nodes with more than a thousandth of all edges (and
    over 1000), are at most 2000; their edges are dealt to `places` tasks each, so neither hubs nor
    long chains gather in one place. The lineage is cut each round.
    """
    def fingerprint(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(e: DataFrame, least: DataFrame, n: int) -> DataFrame:
        """Each edge (u, v) with the least m of its u; `least` is (x, m, c) with a node's number of edges."""
        most = max(1000, 2 * n // 1000)
        hubs = F.broadcast(least.where(F.col("c") > most).select(F.col("x").alias("_hub")))
        dealt = e.join(hubs, F.col("u") == F.col("_hub"), "left").select("u", "v", F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(places))).otherwise(0).cast("int").alias("place"))
        to = F.explode(F.when(F.col("c") > most, F.sequence(F.lit(0), F.lit(places - 1))).otherwise(F.array(F.lit(0))))
        return dealt.join(least.select("x", "m", to.alias("_place")), (F.col("u") == F.col("x")) & (F.col("place") == F.col("_place")))

    def minima(e: DataFrame, m: Column) -> DataFrame:
        return e.groupBy(F.col("u").alias("x")).agg(F.min(m).alias("m"), F.count("*").alias("c"))

    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = fingerprint(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both.where("v > u"), minima(both, F.least("u", "v")), was[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = minima(large, F.col("v"))
        small = with_least(large, least, was[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        now = fingerprint(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and edges i-j: the smallest node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
