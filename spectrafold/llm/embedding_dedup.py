"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into intervals of width
``WIDTH``; ``DIRECTIONS`` interval numbers form the bucket of a table, and there are ``TABLES`` of
them. Vectors that share a bucket (and the label) are compared exactly. For unit vectors of cosine
0.93 (distance 0.374) an interval number agrees with probability 0.75, so a pair at the very
threshold is found with probability 1 - (1 - 0.75^8)^24 = 0.92, closer ones more surely.

Equal vectors of a label are one class with a number of copies, compared once. A pair counts in
the first table where it meets, so that links can be added up; tasks hand on numbers of links
and a spanning forest of each bucket, never all pairs. A bucket beyond ``BLOCK`` vectors is cut into
blocks, and each pair of blocks is a task's unit.

Results for odd input: null labels, null, zero or empty vectors and vectors with a null or
non-finite value link with nothing; vectors of different lengths never link; null ids are compared
like others but name a component only if it has no other id; repeated rows are copies of each
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import vector
from ..blas import single_threaded
from ..session import durable
from .components import components
from .registry import query, table
from .textblocks import mix64

LEAST = 0.93
TABLES, DIRECTIONS, WIDTH = 24, 8, 1.2
BLOCK = 1000
SEED = 20240229


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def buckets(unit: np.ndarray, tables: int, directions: int, width: float) -> np.ndarray:
    """The bucket of each row (first index) in each table."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    along = rng.standard_normal((unit.shape[1], tables * directions))
    shift = rng.random(tables * directions) * width
    number = np.floor((unit @ along + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, directions)
    value = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] * 1000), number.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(directions):
            value = mix64(value + number[:, :, i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
    return value.view(np.int64)


def matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=float)
    ends = np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[(ends[rows] - n)[:, None] + np.arange(n)]


class Forest:
    """Union-find over the rows of a group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of consecutive rows with equal keys, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        same[0] = False
        for k in keys:
            v = vector(batch.column(k))
            same[1:] &= v[1:] == v[:-1]
        cuts = np.append(np.flatnonzero(~same), batch.num_rows)
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            key = tuple(piece.column(k)[0].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            last = key
    if held:
        yield pa.Table.from_batches(held)


def with_size(rows: DataFrame, key: str, size: str = "met") -> DataFrame:
    """``rows`` (light ones) with the number of rows that share the key."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(size))
    return rows.join(counts, F.col(key) == F.col("_key")).drop("_key")


def block_cells(rows: DataFrame, size: str, block: int, spread: str) -> DataFrame:
    """``rows`` with _i, _j, _side: keys of more than ``block`` rows are cut, and each pair of cuts is a cell.

    In the cell (i, j) the rows of cut i meet those of cut j; _side says which a row is. ``size`` names the
    column with the number of rows of a key, ``spread`` the one that decides the cut of a row.
    """
    cuts = F.ceil(F.col(size) / block).cast("int")
    cut = rows.withColumn("_own", F.pmod(F.xxhash64(spread), cuts).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return (cut.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
            .withColumn("_side", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other"))


def _compare(least: float, tables: int, directions: int, width: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for group in by_group(batches, ["bucket", "_i", "_j"]):
            if group.num_rows < 2:
                continue
            node, copies, label = (vector(group[c]) for c in ("node", "copies", "label"))
            side, t = vector(group["_side"]), int(group["t"][0].as_py())
            across = bool(vector(group["_i"])[0] != vector(group["_j"])[0])
            for rows, x in matrices(group["v"]):
                unit = unit_rows(x)
                own = buckets(unit, tables, directions, width)
                close = unit @ unit.T >= least
                close &= label[rows][:, None] == label[rows][None, :]
                a, b = np.nonzero(np.triu(close, 1))
                if across:
                    keep = side[rows][a] != side[rows][b]
                    a, b = a[keep], b[keep]
                a, b = _first_meeting(own, a, b, t)
                if not len(a):
                    continue
                links = np.bincount(a, copies[rows][b], len(rows)) + np.bincount(b, copies[rows][a], len(rows))
                forest = Forest(len(rows))
                tree = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if forest.join(i, j)]
                linked = np.flatnonzero(links)
                ends = np.array(tree)
                n, m = len(linked), len(tree)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[rows][linked], node[rows][ends[:, 0]]])),
                     pa.array(np.concatenate([links[linked].astype(np.int64), np.zeros(m, np.int64)])),
                     pa.array([None] * n + node[rows][ends[:, 1]].tolist(), pa.int64())], names=["a", "links", "b"])

    return run


def _first_meeting(own: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common bucket is that of table ``t``."""
    keep = np.empty(len(a), bool)
    for s in range(0, len(a), 100_000):
        part = slice(s, s + 100_000)
        keep[part] = (own[a[part]] == own[b[part]]).argmax(axis=1) == t
    return a[keep], b[keep]


def near_vectors(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, directions: int = DIRECTIONS,
                 width: float = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 block: int = BLOCK) -> DataFrame:
    """One row per vector: its id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("v"))
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    parts = (rows.filter("usable").groupBy("label", "v", "salt").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    classes = parts.groupBy("label", "v").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))

    # labels are compared through a number of their own
    names = durable(classes.select("label").distinct().withColumn("number", F.monotonically_increasing_id()))
    coded = classes.join(names, "label").select("node", "copies", F.col("number").alias("label"), "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for batch in batches:
            for found, x in matrices(batch.column("v")):
                own = buckets(unit_rows(x), tables, directions, width)
                at = pa.array(np.repeat(found, tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.reshape(-1)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(found))),
                     batch.column("node").take(at), batch.column("label").take(at)], names=["bucket", "t", "node", "label"])

    placed = coded.select("node", "label", "v").mapInArrow(place, "bucket long, t int, node long, label long")
    placed = durable(placed.select(F.xxhash64("bucket", "label").alias("bucket"), "t", "node"))
    # only buckets with company get the vectors themselves
    cells = block_cells(with_size(placed, "bucket").filter("met > 1"), "met", block, "node").drop("met").join(coded, "node")
    cells = cells.repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j", "node")
    met = durable(cells.mapInArrow(_compare(least, tables, directions, width), "a long, links long, b long"))

    links = met.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(met.filter("b is not null").select("a", "b"))
    verdict = (classes.select("node", "first", "copies", "label", "v").join(links, "node", "left").join(roots, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    lowest = verdict.groupBy("root").agg(F.min("first").alias("component_id"))
    verdict = durable(verdict.join(lowest, "root").select(
        "label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # back over the salted parts, so that a hot vector's copies are spread
    back = parts.select("label", "v", "salt").join(verdict, ["label", "v"])
    out = rows.filter("usable").join(back, ["label", "v", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.select(F.col("vec_id").alias(id_col), "n_links", "component_id",
                       F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op9_embedding_dedup")
def op9(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
