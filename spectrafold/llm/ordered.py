"""Rows in one global order, cut into blocks, with sums that run on from block to block.

A table is range-sorted by a key and what orders the rows of a key, and written once; a partition of
it is a block. A key with a third of all rows so lies in many blocks like any other. What a block needs
from those before it is one record a block; only these reach the driver (their number is that of the
partitions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable


def sorted_blocks(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in the order of the named columns (nulls first), with ``block``; checkpointed."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id().cast("long")))


def _segments(keys: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def running(blocks: DataFrame, key: str, lanes: tuple[str, ...] = ()) -> DataFrame:
    """``pos`` (1 for the first row of a key) and, for each lane column, the sum of its values up to the row
    modulo 2^64, in place of the lane; ``before_<lane>`` is that sum without the row's own value.

    ``blocks`` comes from ``sorted_blocks`` with ``key`` (a long, never null) first; lanes are longs.
    """
    names = list(lanes)

    def walk(batches: Iterator[pa.RecordBatch], carry: tuple | None):
        """Batches with their running columns, and at last the state after the block's last row."""
        first, state = None, carry
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if first is None:
                first = int(keys[0])
            starts = _segments(keys)
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            columns, ends = [], []
            goes_on = state is not None and state[0] == int(keys[0])
            for i, lane in enumerate(["", *names]):
                own = np.ones(len(keys), np.uint64) if not lane else batch.column(lane).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                total = np.cumsum(own, dtype=np.uint64)
                total -= (total[starts] - own[starts])[run]
                if goes_on:
                    total[run == 0] += np.uint64(state[1][i])
                ends.append(int(total[-1]))
                columns.append(total.view(np.int64))
                if lane:
                    columns.append((total - own).view(np.int64))
            state = (int(keys[-1]), tuple(ends))
            yield batch, columns
        yield first, state

    def edges(batches):
        block = None

        def noted():
            nonlocal block
            for batch in batches:
                if batch.num_rows and block is None:
                    block = batch.column("block")[0].as_py()
                yield batch

        for first, state in walk(noted(), None):
            pass
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": [block], "first": [first], "last": [state[0]],
                                              "ends": [[int(np.uint64(v).view(np.int64)) for v in state[1]]]})

    read = blocks.select(key, "block", *names)
    found = sorted(read.mapInArrow(edges, "block long, first long, last long, ends array<long>").collect())
    carries, before = {}, None
    for block, first, last, ends in found:
        ends = [v % (1 << 64) for v in ends]
        if before is not None and before[0] == first:
            carries[block] = before
            if first == last:  # the key fills the block
                ends = [(a + b) % (1 << 64) for a, b in zip(ends, before[1])]
        before = (last, tuple(ends))

    rest = [c for c in blocks.columns if c not in names]
    made = ["pos"] + [n for lane in names for n in (lane, f"before_{lane}")]
    schema = T.StructType([blocks.schema[c] for c in rest] + [T.StructField(n, T.LongType()) for n in made])

    def apply(batches):
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        carry = carries.get(head.column("block")[0].as_py())

        def chained():
            yield head
            yield from batches

        for batch, columns in walk(chained(), carry):
            if isinstance(batch, pa.RecordBatch):
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(c) for c in columns], names=rest + made)

    return blocks.mapInArrow(apply, schema)
