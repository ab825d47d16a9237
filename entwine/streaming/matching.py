"""An extension: entities that arrive as a stream are matched against a pool that is at rest.

Each micro-batch is a batch run of the same operators; the pool is normalised
once. Blocking statistics are those of the batch and the pool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import candidates as cand
from ..operators.canonical import canonicalize


def match_stream(arriving: DataFrame, pool: DataFrame, sink: Callable[[DataFrame, int], None], channels: list[str] | None = None, budget: int = 20) -> DataStreamWriter:
    """A writer, yet to be started, that hands each batch's pruned candidates to `sink(pairs, batch id)`.

    `arriving` has the record columns with row_ord; `pool` is canonical. A batch that
    is repeated after a failure gives the same pairs, so a sink that
    overwrites by batch id is exactly once.
    """
    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        s1 = canonicalize(batch)
        pruned, _ = cand.block_and_prune(s1, pool, budget, channels=channels or ["c1_exact", "c3_rare", "c8_token_overlap"])
        sink(pruned.select("s1", "r", "mask", "n_channels", "ord", F.lit(number).alias("batch")), number)

    return arriving.writeStream.foreachBatch(each)
