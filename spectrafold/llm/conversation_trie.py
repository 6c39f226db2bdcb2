"""The trie of common beginnings of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by its depth and two 64-bit sums of hashes of its turns'
digests and depths: running sums over the conversations in one global order, so that neither
a long conversation nor a frequent beginning meets in one task.

Subtree totals flow from the leaves up. A node is heavy when more than ``limit`` turns lie below it; the limit
is the larger of ``LEAST_SHARD`` and what keeps the heavy nodes at ``HEAVY`` in the whole trie. The heavy nodes form the
top; each light node whose parent is heavy is the root of a shard. Within a shard the nodes come in reverse level
order from Spark's external sort, and a priority queue, ordered likewise, holds what has been sent to parents that
are yet to come; beyond ``QUEUE`` messages it spills sorted runs. The totals of shard roots are summed by
heavy parent before they are sent, and the top, bounded by its definition, is done by the same pass.

Results for odd input: a null role or text is empty; null turns come first; turns of equal number follow the
digest of role and text; repeated rows are repeated turns; rows with a null conv_id belong to no conversation
and are left out; a conversation without turns is a member of the root; an empty table has no nodes;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .conversation_repair import CRC
from .ordered import running, sorted_blocks
from .registry import query, table

HEAVY = 50_000  # nodes of the top, at most
LEAST_SHARD = 20_000  # turns below a node that may be done in one shard
QUEUE = 200_000  # messages in memory
CHUNK = 1 << 16  # characters of a piece of an id list
NODE = ["depth", "a", "b"]


class SpillQueue:
    """A priority queue of equally long tuples of 64-bit numbers that spills sorted runs.

    Runs lie in anonymous temporary files of the task, as Spark's own sort spills do; nothing outlives the task,
    and a task that is run again makes them anew.
    """

    def __init__(self, width: int, limit: int = QUEUE):
        self.width, self.limit = width, limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # head, number of the run, rest
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        np.asarray(self.heap, np.int64).tofile(file)
        file.seek(0)
        self.heap = []
        self.spilled += 1
        rest = self._read(file)
        heapq.heappush(self.runs, (next(rest), self.spilled, rest))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while data := file.read(8 * self.width * 4096):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, self.width).tolist())

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, rest = heapq.heappop(self.runs)
            after = next(rest, None)
            if after is not None:
                heapq.heappush(self.runs, (after, number, rest))
            return head
        return heapq.heappop(self.heap)


# -- rebuilt conversations ---------------------------------------------------------------

def shared_starts(df: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth, g0, g1, bytes, length: conversations that begin with turns of their family's first one.

    Conversation c takes its first h turns, h = crc32(c) % ``most``, from conversation c - c % ``family``, as far as
    that has them, then follow its own turns after its first h. Without a turn: depth 0 and nulls.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = df.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), half[0].alias("g0"), half[1].alias("g1"),
                                                   F.octet_length(text).cast("long").alias("bytes"))
    # equal rows are told apart only so that they may lie in several blocks
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    placed = running(sorted_blocks(rows, "conv_id", "turn", "g0", "g1", "copy"), "conv_id").select("conv_id", "pos", "g0", "g1", "bytes")
    placed = durable(placed)
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                         (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0).cast("long"))))
    convs = durable(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))))
    turn = ["g0", "g1", "bytes"]
    own = (placed.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), *turn, "length"))
    lent = (placed.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
            .join(convs.select("conv_id", "base", "h", "length"), "base").filter("pos <= h")
            .select("conv_id", F.col("pos").alias("depth"), *turn, "length"))
    nothing = F.lit(None).cast("long")
    bare = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[nothing.alias(c) for c in turn], "length")
    return own.unionByName(lent).unionByName(bare)


# -- the trie ----------------------------------------------------------------------------

def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, above_a, above_b, bytes, length: the node of every turn, and its parent's sums."""
    rows = turns.filter("depth > 0").withColumn("mixed_a", F.xxhash64("g0", "g1", "depth", F.lit(3))).withColumn(
        "mixed_b", F.xxhash64(F.lit(7), "g1", F.lit(5), "g0", "depth"))
    blocks = sorted_blocks(rows.select("conv_id", "depth", F.col("mixed_a").alias("a"), F.col("mixed_b").alias("b"), "bytes", "length"), "conv_id", "depth")
    return running(blocks, "conv_id", ("a", "b")).select("conv_id", "depth", "a", "b", F.col("before_a").alias("above_a"),
                                                         F.col("before_b").alias("above_b"), "bytes", "length")


def heavy_nodes(pairs: DataFrame, lengths: DataFrame, heavy: int = HEAVY, least: int = LEAST_SHARD) -> tuple[int, list[tuple]]:
    """The limit of a shard, and the nodes with more turns below them; no more than ``heavy`` whatever the data."""
    total = lengths.agg(F.sum(F.col("length").cast("double") * (F.col("length") + 1) / 2)).first()[0] or 0.0
    limit = max(least, int(total / heavy) + 1)
    below = pairs.groupBy(*NODE).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("below")).filter(F.col("below") > limit)
    return limit, [tuple(r) for r in below.select(*NODE).collect()]


def _sharded(pairs: DataFrame, heavy: list[tuple]) -> DataFrame:
    """``pairs`` with ``top`` (a heavy node) and the name of the shard of a light one.

    ``pairs`` is in the order of conversations and depths; along a conversation the heavy nodes come first, so the shard is that
    of the first light node. It is known to each row by the sums of that node: carried along as in a running sum.
    """
    spark = pairs.sparkSession
    known = spark.createDataFrame(heavy, "depth long, a long, b long").withColumn("top", F.lit(True))
    marked = pairs.join(F.broadcast(known), NODE, "left").withColumn("top", F.coalesce("top", F.lit(False)))
    # the first light node of each conversation: one row a conversation, bounded by the turns
    first = (marked.filter(~F.col("top")).groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("shard")))
    return marked.join(first, "conv_id", "left").withColumn("shard", F.when(~F.col("top"), F.xxhash64("shard")))


def time_forward(batches: Iterator[pa.RecordBatch], limit: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come by shard, and by falling depth and name within it.

    A row whose ``kind`` is 0 is no node but the summed totals of children in other shards; it comes before its node.
    Each node takes the messages addressed to it from the queue and sends its own to its parent.
    """
    names = ("shard", "depth", "a", "b", "kind", "above_a", "above_b", "own", "children", "leaves", "saved")
    queue, now = SpillQueue(6, limit), None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            shard, depth, a, b, kind, up_a, up_b, own, children, leaves, saved = row
            if shard != now:
                queue, now = SpillQueue(6, limit), shard
            if kind == 0:
                queue.push((-depth, a, b, children, leaves, saved))
                continue
            children = leaves = 0
            saved = own
            here = (-depth, a, b)
            while (head := queue.least()) is not None and head[:3] <= here:
                message = queue.pop()
                if message[:3] == here:
                    children += message[3]
                    leaves += message[4]
                    saved += message[5]
            leaves = leaves if children else 1
            out.append((depth, a, b, up_a, up_b, children, leaves, saved))
            if depth:
                queue.push((1 - depth, up_a, up_b, 1, leaves, saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                             names=["depth", "a", "b", "above_a", "above_b", "children", "leaves", "saved"])


_TOTALS = "depth long, a long, b long, above_a long, above_b long, children long, leaves long, saved long"


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: digest of the ascending decimal conv_ids of each node, comma-joined.

    Ids are sorted over all nodes in blocks and joined to pieces of text there; a node's pieces are hashed in turn.
    """
    blocks = sorted_blocks(ends.select(*NODE, "conv_id"), *NODE, "conv_id")

    def pieces(batches):
        key, held, size, at, block = None, [], 0, 0, 0
        out: list[tuple] = []
        for batch in batches:
            for depth, a, b, conv, block in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id", "block"))):
                if (depth, a, b) != key or size > CHUNK:
                    if held:
                        out.append((*key, block, at, ",".join(held)))
                        at += 1
                    key, held, size = (depth, a, b), [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) > 1000:
                yield _piece_batch(out)
                out = []
        if held:
            out.append((*key, block, at, ",".join(held)))
        if out:
            yield _piece_batch(out)

    def digests(batches):
        key, state, done = None, None, []
        for batch in batches:
            for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (depth, a, b) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(done) > 1000:
                yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), zip(*done))))
                done = []
        if key is not None:
            done.append((*key, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), zip(*done))))

    parts = blocks.mapInArrow(pieces, "depth long, a long, b long, block long, at long, ids string")
    ordered = parts.repartition(*NODE).sortWithinPartitions(*NODE, "block", "at")
    return ordered.mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip((*NODE, "block", "at", "ids"), zip(*rows))))


def prefix_trie(turns: DataFrame, heavy: int = HEAVY, least: int = LEAST_SHARD, queue: int = QUEUE) -> DataFrame:
    """The nodes of the trie of conversations given as by ``shared_starts``."""
    turns = durable(turns)
    lengths = turns.groupBy("conv_id").agg(F.max("length").alias("length"))
    pairs = durable(prefixes(turns))
    limit, top = heavy_nodes(pairs, lengths, heavy, least)
    marked = _sharded(pairs, top)
    nodes = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.first("above_a").alias("above_a"),
        F.first("above_b").alias("above_b"), F.first("top").alias("top"), F.first("shard").alias("shard"),
        F.sum((F.col("length") == F.col("depth")).cast("long")).alias("n_ends"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("length") == 0).cast("long")).alias("n_ends"))
    root = root.filter("n_convs > 0").select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("bytes"), zero.alias("above_a"),
                                             zero.alias("above_b"), F.lit(True).alias("top"), F.lit(None).cast("long").alias("shard"), "n_ends")
    nodes = durable(nodes.unionByName(root))

    none = [F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    value = ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")
    rows = nodes.select(F.coalesce("shard", F.lit(0).cast("long")).alias("shard"), *NODE, F.lit(1).cast("long").alias("kind"), "above_a", "above_b", value, *none, "top")
    order = ["shard", F.desc("depth"), "a", "b", "kind"]

    def walk(batches):
        return time_forward(batches, queue)

    low = durable(rows.filter(~F.col("top")).drop("top").repartition("shard").sortWithinPartitions(*order).mapInArrow(walk, _TOTALS))
    # what the roots of shards tell their heavy parents, summed before it is sent
    heads = rows.filter(F.col("top")).select(*NODE)
    parent = low.select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b"), "leaves", "saved")
    told = (parent.join(F.broadcast(heads), NODE, "left_semi").groupBy(*NODE)
            .agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    told = told.select(zero.alias("shard"), *NODE, zero.alias("kind"), zero.alias("above_a"), zero.alias("above_b"), zero.alias("own"), "children", "leaves", "saved")
    high = (rows.filter(F.col("top")).drop("top").withColumn("shard", zero).unionByName(told)
            .repartition(1).sortWithinPartitions(*order).mapInArrow(walk, _TOTALS))

    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("parent_conv_id"))
    ended = turns.filter("depth = 0").select(*[zero.alias(c) for c in NODE], "conv_id").unionByName(
        pairs.filter("length = depth").select(*NODE, "conv_id"))
    whole = (nodes.select(*NODE, "conv_id", "n_convs").join(low.unionByName(high), NODE)
             .join(names, ["depth", "above_a", "above_b"], "left").join(id_digests(ended), NODE, "left"))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


# a node is the joined digests of its turns; a node's subtree lies under the prefixes of its smallest member
_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, {CRC.format('name')} % 9 AS h
  FROM (SELECT conv_id, max(pos) AS n, CAST(conv_id AS VARCHAR) AS name FROM placed GROUP BY conv_id)),
kept AS (
  SELECT c.*, least(h, coalesce(b.m, 0)) AS taken FROM convs c LEFT JOIN (SELECT conv_id AS base, n AS m FROM convs) b USING (base)),
turns AS (
  SELECT p.conv_id, p.pos - k.h + k.taken AS depth, role, text FROM placed p JOIN kept k USING (conv_id) WHERE p.pos > k.h
  UNION ALL SELECT k.conv_id, p.pos, role, text FROM placed p JOIN kept k ON p.conv_id = k.base AND p.pos <= k.h),
pairs AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(sha256(length(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS node,
         count(*) OVER (PARTITION BY conv_id) AS length FROM turns
  UNION ALL SELECT k.conv_id, 0, 0, '', coalesce(t.n, 0) FROM kept k LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) t USING (conv_id)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, max(length) = depth AS leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM pairs GROUP BY depth, node),
parents AS (
  SELECT n.depth, n.node, p.depth AS up, p.node AS above, m.conv_id AS parent_conv_id
  FROM nodes n JOIN pairs p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes m ON m.depth = p.depth AND m.node = p.node),
below AS (
  SELECT a.depth, a.node, sum(n.own) AS saved, count(*) FILTER (n.leaf) AS leaves
  FROM nodes n JOIN pairs a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.node)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(c.children, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, node) LEFT JOIN parents p USING (depth, node)
  LEFT JOIN (SELECT up AS depth, above AS node, count(*) AS children FROM parents GROUP BY up, above) c USING (depth, node)
"""


@query("op11_conversation_trie", _SQL)
def conversation_trie(spark, folder):
    """The trie of all conversations that share beginnings with the first of their family."""
    return prefix_trie(shared_starts(table(spark, folder, "conversations")))
