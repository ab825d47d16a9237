"""Running sums in two levels, for orders too long for one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def running_sums(df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add exclusive running sums (new column -> summed column) per key in the order of (chunk, order).

    Sums inside (key, chunk) are shifted by the totals of the key's chunks before.
    Keys and chunks must not be null.
    """
    by = [*keys, chunk]
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by).agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    shifts = totals.select(*by, *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    local = df.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()))
    return local.join(shifts, by).withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop(*(f"_{k}" for k in sums))


#: Temporary folders made for sessions on one machine, by application.
_made: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data, `spark.checkpoint.dir`.

    Where the setting is absent, a temporary folder is made on one machine; with
    other masters it is an error, as executors could not see each other's files.
    """
    import tempfile

    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _made:
        _made[sc.applicationId] = tempfile.mkdtemp(prefix="entwine-scratch-")
    return _made[sc.applicationId]


def materialise(df: DataFrame) -> DataFrame:
    """Cut the plan with a checkpoint in the cluster's shared folder.

    Normalised records are used by every channel, and a filter on one of their
    columns would otherwise be pushed below all steps that made it, which
    repeats those steps once for each use.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the plan by Parquet in the shared folder: less disk than a checkpoint, read column by column, and of known size."""
    path = f"{scratch(df.sparkSession)}/entwine-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
