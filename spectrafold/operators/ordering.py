"""Row positions and windows over a global order, without a single-task sort.

A window without PARTITION BY moves the table into one task, and a window per group moves a
hot group there. Positions come from a range-partitioned sort instead; windows run over
equally sized position blocks that borrow their neighbours' edge rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_index(df: DataFrame, order_by: list, name: str = "ix") -> tuple[DataFrame, int]:
    """Append the dense 0-based position in ``order_by`` and return it with the row count.

    The sorted rows are checkpointed once, so the counts and the rows that use them agree;
    the table of counts has one row per partition.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_id", F.monotonically_increasing_id()))
    kept = durable(ranged)
    part = F.shiftright("_id", _LOCAL_BITS)
    counts = sorted((r["part"], r["count"])
                    for r in kept.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for number, rows in counts:
        offsets.append((number, total))
        total += rows
    small = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = (kept.join(F.broadcast(small), part == F.col("_part"))
           .withColumn(name, F.col("_offset") + local))
    return out.drop("_id", "_part", "_offset"), total


def rank_within(df: DataFrame, group: str, order_by: list, name: str = "rank",
                size: str | None = None) -> DataFrame:
    """0-based position inside each group, a hot group being spread over many tasks.

    The position is the global one minus the group's first; the group table has one row per
    group and joins by the planner's choice.
    """
    ordered, _ = with_index(df, [F.col(group), *order_by], "_pos")
    starts = ordered.groupBy(F.col(group).alias("_g")).agg(F.min("_pos").alias("_start"),
                                                           F.count("*").alias("_size"))
    out = (ordered.join(starts, F.col(group).eqNullSafe(F.col("_g")))
           .withColumn(name, F.col("_pos") - F.col("_start")))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_pos", "_g", "_start", "_size")


def halo_blocks(df: DataFrame, before: int = 0, after: int = 0, rows: int = 50_000,
                ix: str = "ix") -> DataFrame:
    """Cut the order into blocks of ``rows`` and lend each block its neighbours' edge rows.

    Adds ``_block`` and ``_home`` (false for lent rows). Windows over ``block_window`` are
    exact for frames of up to ``before``/``after`` rows; drop lent rows afterwards.
    """
    if max(before, after) > rows:
        raise ValueError("a frame cannot be longer than a block")
    home = F.floor(F.col(ix) / rows)
    place = F.col(ix) % rows
    blocks = F.array_compact(F.array(
        home,
        F.when(place >= rows - before, home + 1),
        F.when((place < after) & (home > 0), home - 1),
    ))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == home)


def block_window(ix: str = "ix") -> W:
    return W.partitionBy("_block").orderBy(ix)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_block", "_home")


def shuffled_positions(ix: np.ndarray, n: int, seed: int, rounds: int = 24) -> np.ndarray:
    """Swap-or-not shuffle of positions (Hoang, Morris and Rogaway 2012), vectorised.

    A round pairs i with (k - i) mod n and swaps the pair on a hash bit of the larger one: a
    bijection of 0..n-1 for every n.
    """
    at = ix.astype(np.uint64)
    size = np.uint64(max(n, 1))
    with np.errstate(over="ignore"):
        for r in range(rounds):
            salt = _mix(np.array([(seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)], dtype=np.uint64))
            partner = (salt % size + size - at) % size
            coin = _mix(np.maximum(at, partner) + salt) & np.uint64(1)
            at = np.where(coin == 1, partner, at)
    return at.astype(np.int64)


def _mix(v: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def permuted(ix, n: int, seed: int) -> Column:
    """A seeded permutation of 0..n-1 of the position, row-locally.

    Exact fold and split sizes need no sort, and a recomputed row gets the same place.
    """
    @F.pandas_udf("long")
    def place(s: pd.Series) -> pd.Series:
        return pd.Series(shuffled_positions(s.to_numpy(), n, seed))

    return place(F.col(ix) if isinstance(ix, str) else ix)


def permutations(ix, n: int, seeds: list[int]) -> Column:
    """Several permutations at once, as an array."""
    @F.pandas_udf("array<long>")
    def places(s: pd.Series) -> pd.Series:
        at = s.to_numpy()
        return pd.Series(list(np.stack([shuffled_positions(at, n, seed) for seed in seeds], axis=1)))

    return places(F.col(ix) if isinstance(ix, str) else ix)
