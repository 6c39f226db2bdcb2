"""Exact Jaccard self-join of word n-gram sets with filters under several global orders.

Under any total order of the shingles, two sets with Jaccard similarity t share a shingle among the
first n - ceil(t n) + 1 of each. All orders put rare shingles first, each by a reckoning of its own: how often a
shingle's words would meet by chance, the same in coarse steps, or the count of its rarest word; a hash class of
shingles that is much fuller than usual corrects each of them. Ties are broken by different hashes. Word counts
need no more room on larger corpora than the vocabulary does, so the orders hold at any size.

Equal sets are one class from the start. The first order gives posting lists, sorted in ranges that may split a
list. Along a list, by size, each class is tied to the next one if their sizes allow a link: classes whose
sizes allow one are so connected, with fewer ties than members. What is connected is a candidate
cluster. Before any text moves, the clusters are refined under the other orders in turn, with lists of (cluster, shingle):
a class that meets nobody leaves, and the last order's lists split what is left. Linked classes share a prefix shingle under
every order, so none of their links is lost. A cluster beyond ``BLOCK`` members (or as many
shingles as usual members have) is cut by set size into
steps of which only neighbours can hold links, and a step beyond it into pairs of blocks. Such clusters are first thinned by sketches,
the parities of a set's shingles by hash class (two to four classes for a shingle): two sets differ in at least as many shingles as their sketches do in parities, so that
pairs whose sketches are too far apart can't be links, and what the others connect are the clusters.
Only then the texts of what is left are brought together. In the blocks candidates must once more
share a prefix token under every order, pair by pair, before their sets are compared
exactly. Tasks hand on a spanning forest of the links they find, whose components are those of all
links, and for each class the number of documents that its links reach; never all pairs. Steps overlap: a pair
of classes of one step is counted in that step only.

Results for odd input: a null text, an empty one or one of white space has no shingle and links with
nothing; a text of fewer than ``n`` words has one shingle, all its words; of rows that repeat id and
text one is kept by ``drop_near_copies``; a null id comes last among a component's ids; an empty table
gives an empty result; ``drop_near_copies`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..blas import single_threaded
from ..session import durable
from .components import components
from .embedding_dedup import Forest, block_cells, by_group
from .registry import query, table
from .textblocks import LOWER, binary_column, blocks, mix64, shingle_hashes, span_hashes, word_bounds

WORDS = 3
PERCENT = 90
CLASS_BITS = 18  # hash classes of words and of shingles that are counted
SLICES = 8  # parts in which the counts are summed
SEEDS = (0x8CB92BA72F3D8DD7, 0xAB1C5ED5DA6D8118, 0x6A09E667F3BCC909)  # one for each order
BLOCK = 2048
USUAL = 500  # shingles of a member; a larger set counts as more members
SKETCHED = 8000  # the same for sketches, which are far smaller than sets
PANEL = 256  # members whose pairs with all others are held at once
_CELL = ["cluster", "_i", "_j"]
KNOWN = 100_000  # sets a task remembers so as not to send them twice
SEND = 16 << 20  # bytes of candidates that may be broadcast


@dataclass(frozen=True)
class Ranks:
    """What orders the shingles: log2 of the words' counts by hash class, of what a class of shingles has too much, and of all words."""

    words: np.ndarray
    excess: np.ndarray
    total: float

    def of(self, logs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The rank of each shingle under each order; ``logs`` has a row for each of a shingle's words."""
        excess = self.excess[(own >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
        chance = np.maximum(logs.sum(axis=0, dtype=np.float32) - (len(logs) - 1) * self.total, excess)
        fine = np.clip(np.round(4 * (chance + 32)), 0, 255).astype(np.uint8)
        rarest = np.clip(np.round(8 * np.maximum(logs.min(axis=0), excess)), 0, 255).astype(np.uint8)
        return np.stack([fine, fine >> 3, rarest])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, ranks: Ranks | None = None) -> Iterator:
    """The sorted distinct shingle hashes of each text of a block; with ``ranks`` also their ranks under each order."""
    data = LOWER[data]
    starts, ends, row = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    value, owner = shingle_hashes(words, row, n)
    if ranks is not None and len(value):
        logs = ranks.words[(words >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
        inside = row[:len(words) - n + 1] == row[n - 1:]
        places = ranks.of(np.stack([logs[i:len(words) - n + 1 + i][inside] for i in range(n)]), value)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    spans = np.searchsorted(row, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        if bounds[i] < bounds[i + 1]:
            here = slice(bounds[i], bounds[i + 1])
            if ranks is None:
                yield np.unique(value[here])
            else:
                own, first = np.unique(value[here], return_index=True)
                yield own, places[:, here][:, first]
            continue
        own = value[:0]
        if spans[i] < spans[i + 1]:
            whole = words[spans[i]:spans[i + 1]]
            own = shingle_hashes(whole, np.zeros(len(whole), np.int64), len(whole))[0] ^ np.uint64(len(whole))
        yield own if ranks is None else (own, np.zeros((len(SEEDS), len(own)), np.uint8))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def count_ranks(source: DataFrame, n: int) -> Ranks:
    """Counts of the words and shingles of all documents by hash class.

    The classes are so many whatever the corpus; a task sends one count per class, and their sums
    reach the driver.
    """
    classes = 1 << CLASS_BITS
    width = classes // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, classes), np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                data = LOWER[data]
                starts, ends, row = word_bounds(data, offsets)
                if len(starts):
                    words = span_hashes(data, starts, ends)
                    total[0] += np.bincount((words >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=classes)
                    total[1] += np.bincount((shingle_hashes(words, row, n)[0] >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=classes)
        if total.any():
            parts = [total[k, s * width:(s + 1) * width] for k in (0, 1) for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * SLICES), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())],
                                             names=["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(width, np.int64), None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                total += np.frombuffer(blob, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    total = np.zeros((2 * SLICES, width), np.int64)
    for row in source.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(merge, "part int, counts binary").collect():
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    words, shingles = total.reshape(2, classes)
    usual = float(np.median(shingles[shingles > 0])) if shingles.any() else 0.0
    excess = shingles - usual - 6 * math.sqrt(usual)
    return Ranks(np.log2(np.maximum(words, 1)).astype(np.float32),
                 np.where(excess >= 2, np.log2(np.maximum(excess, 2)), -64).astype(np.float32), math.log2(max(int(words.sum()), 1)))


def prefix(own: np.ndarray, places: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under an order, as numbers that sort by it."""
    size = len(own) - -(-percent * len(own) // 100) + 1
    keys = (places[order].astype(np.uint64) << np.uint64(56)) | (mix64(own ^ np.uint64(SEEDS[order])) >> np.uint64(8))
    return np.partition(keys, size - 1)[:size] if size < len(keys) else keys


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _classes(source: DataFrame, n: int) -> DataFrame:
    """doc_id, mark, e (a digest of the set) and n of each document, rows that repeat counted in copies."""
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name = [], []
            for _, _, data, offsets in blocks(batch.column("text")):
                for own in shingle_sets(data, offsets, n):
                    size.append(len(own))
                    name.append(_digest(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(name, pa.binary()), pa.array(size, pa.int32())],
                                             names=["doc_id", "mark", "e", "n"])

    named = source.mapInArrow(run, f"doc_id {kind.simpleString()}, mark long, e binary, n int")
    return named.groupBy("doc_id", "mark", "e", "n").agg(F.count(F.lit(1)).alias("copies"))


_POSTING = "cluster binary, token long, n int, e binary"


def _postings(texts: DataFrame, ranks: Ranks, n: int, percent: int, orders: tuple[int, ...]) -> DataFrame:
    """A row for each prefix shingle of each class of sets under the orders; ``texts`` may name the class wanted of a text in ``want``."""
    names = [c for c in ("text", "want") if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()  # sets whose postings this task has sent of late
        for batch in batches:
            want = batch.column("want").to_pylist() if "want" in names else None
            for first, _, data, offsets in blocks(batch.column("text")):
                token, size, name, order = [], [], [], []
                for at, (own, places) in enumerate(shingle_sets(data, offsets, n, ranks), first):
                    digest = _digest(own)
                    if len(own) and digest not in known and (want is None or want[at] == digest):
                        if len(known) >= KNOWN:
                            known.clear()
                        known.add(digest)
                        for k in orders:
                            token.append(prefix(own, places, k, percent))
                            size.append(len(own))
                            name.append(digest)
                            order.append(k)
                if token:
                    repeat = np.array([len(k) for k in token])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(order, np.int32), repeat)), pa.array(np.concatenate(token).view(np.int64)),
                         pa.array(np.repeat(np.array(size, np.int32), repeat)),
                         binary_column(np.frombuffer(b"".join(name), "S16").repeat(repeat), 16)], names=["order", "token", "n", "e"])

    return texts.select(*names).mapInArrow(run, "order int, token long, n int, e binary")


def _ties(postings: DataFrame, percent: int) -> DataFrame:
    """a, b: the smallest and each other class of a run in a list (of cluster and token, by size) along which sizes allow links.

    Lists lie in ranges; the ends of neighbouring ranges are tied on the driver, two rows a range.
    """
    spark = postings.sparkSession
    key = ["cluster", "token", "n", "e"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.select(*key).repartitionByRange(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, edge = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                edge.append(batch.slice(0, 1))
            rows = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks()
            last = batch.slice(batch.num_rows - 1, 1)
            low, high = rows.slice(0, rows.num_rows - 1), rows.slice(1)
            size = [np.asarray(x["n"]).astype(np.int64) for x in (low, high)]
            same = pc.and_(pc.equal(low["token"], high["token"]), pc.equal(low["cluster"], high["cluster"]))
            tied = np.asarray(same) & (100 * size[0] >= percent * size[1])
            at = np.arange(len(tied) + 1)
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), at, 0))  # of each row's run
            inner = np.flatnonzero(first < at)
            found = pa.table({"a": rows["e"].take(pa.array(first[inner])), "b": rows["e"].take(pa.array(inner))})
            found = found.filter(pc.not_equal(found["a"], found["b"])).group_by(["a", "b"]).aggregate([])
            none = pa.nulls(found.num_rows, pa.int32())
            yield from pa.table({"a": found["a"], "b": found["b"], "part": none, "edge": pa.nulls(found.num_rows, pa.string())}).to_batches()
        if last is not None:
            part = TaskContext.get().partitionId()
            for row in (edge[0], last):
                own = row.to_pylist()[0]
                note = f"{own['cluster'].hex()} {own['token']} {own['n']} {own['e'].hex()}"
                yield pa.RecordBatch.from_pydict({"a": [own["e"]], "b": [own["e"]], "part": [part], "edge": [note]},
                                                 schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("part", pa.int32()), ("edge", pa.string())]))

    found = durable(ordered.mapInArrow(run, "a binary, b binary, part int, edge string"))
    ends: dict[int, list] = {}
    for row in found.filter("part is not null").select("part", "edge").collect():
        cluster, token, n, e = row["edge"].split(" ")
        ends.setdefault(row["part"], []).append((cluster, int(token), int(n), e))
    more, before = [], None
    for part in sorted(ends):
        low, high = min(ends[part], key=lambda v: (v[0], v[1], v[2], v[3])), max(ends[part], key=lambda v: (v[0], v[1], v[2], v[3]))
        if before and before[:2] == low[:2] and before[3] != low[3] and 100 * before[2] >= percent * low[2]:
            more.append((bytes.fromhex(before[3]), bytes.fromhex(low[3])))
        before = high
    ties = found.filter("part is null").select("a", "b")
    if more:
        # as Arrow they are a local table; a list would be read by Python workers of another kind, which stay beside the usual ones
        ties = ties.unionByName(spark.createDataFrame(pa.table({c: pa.array([pair[k] for pair in more], pa.binary()) for k, c in enumerate("ab")})))
    return ties.distinct()


def _clusters(ties: DataFrame) -> DataFrame:
    return components(durable(ties)).select(F.col("node").alias("e"), F.col("root").alias("cluster"))


def candidates(source: DataFrame, own: DataFrame, ranks: Ranks, n: int, percent: int) -> DataFrame:
    """e, cluster, n, copies, _id, _mark of the classes that may have links, refined under all orders.

    ``_id`` and ``_mark`` name a document that has the class's text.
    """
    first = _postings(source, ranks, n, percent, (0,)).withColumn("cluster", F.unhex(F.lit("")))
    clusters = durable(_clusters(_ties(first, percent)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    lowest = own.filter("n > 0").groupBy("e").agg(F.min(place).alias("low"), F.first("n").alias("n"), F.sum("copies").alias("copies"))
    light = clusters.join(lowest, "e").select("e", "n", "copies", F.col("low.doc_id").alias("_id"), F.col("low.mark").alias("_mark"))
    light = durable(light)
    tokens = durable(_postings(_texts(source, light.withColumnRenamed("e", "want")), ranks, n, percent, tuple(range(1, len(SEEDS)))))
    for order in range(1, len(SEEDS)):
        # a class that meets nobody of its cluster under an order is out
        ties = durable(_ties(tokens.filter(F.col("order") == order).join(clusters, "e"), percent))
        met = ties.select(F.explode(F.array("a", "b")).alias("e")).distinct()
        clusters = durable(clusters.join(met, "e", "left_semi"))
    # what the last order still ties within the clusters of the others
    alive = clusters.select("e")
    ties = ties.join(alive.withColumnRenamed("e", "a"), "a", "left_semi").join(alive.withColumnRenamed("e", "b"), "b", "left_semi")
    return _clusters(ties).join(light, "e")


def _texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the documents named by _id and _mark, and the other columns of ``wanted``."""
    wanted = F.broadcast(wanted) if wanted.count() * 150 <= SEND else wanted
    return source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))


def _weighed(rows: DataFrame, usual: int = USUAL) -> DataFrame:
    """``rows`` with met, the members of their cluster, sets of more than ``usual`` shingles counted as more."""
    met = rows.groupBy(F.col("cluster").alias("_key")).agg(F.sum(F.greatest(F.lit(1.0), F.col("n") / usual)).alias("met"))
    return rows.join(met, F.col("cluster") == F.col("_key")).drop("_key")


def _stepped(rows: DataFrame, percent: int, block: int, usual: int = USUAL) -> DataFrame:
    """``rows`` (weighed) with clusters beyond ``block`` cut into steps of set size, and weighed anew.

    A class is in its own step (_home) and in the next one.
    """
    step = F.floor(F.log("n") / F.lit(max(math.log(100 / percent), 1e-9) * 1.000001))
    steps = F.when(F.col("met") > block, F.array(step, step + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    cut = rows.withColumn("_step", F.explode(steps)).withColumn("_home", (F.col("_step") == -1) | (F.col("_step") == step)).drop("met")
    return _weighed(cut.withColumn("cluster", F.concat("cluster", F.encode(F.col("_step").cast("string"), "UTF-8"))), usual)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash class, packed; classes are a power of two, at least two for each shingle."""
    classes = max(64, 1 << int(2 * len(own) - 1).bit_length())
    count = np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little")


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """e and bits, the sketch, of each class that ``texts`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("e").to_pylist()
            for first, _, data, offsets in blocks(batch.column("text")):
                made = [(wanted[at], sketch(own).tobytes()) for at, own in enumerate(shingle_sets(data, offsets, n), first)
                        if _digest(own) == wanted[at]]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)], names=["e", "bits"])

    return texts.select("e", "text").mapInArrow(run, "e binary, bits binary").groupBy("e").agg(F.min("bits").alias("bits"))


def near_sketches(bits: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may be similar enough, by the parities in which their sketches differ."""
    width = min(len(b) for b in bits)
    packed = np.stack([np.bitwise_xor.reduce(b.reshape(-1, width), axis=0) for b in bits])
    both = np.zeros((len(bits), len(bits)), np.int32)
    many = max(1, (1 << 19) // len(bits))
    for at in range(0, width, many):
        x = np.unpackbits(packed[:, at:at + many], axis=1).astype(np.float32)
        np.add(both, x @ x.T, out=both, casting="unsafe")
    odd = both.diagonal().astype(np.int64)
    near = np.empty(both.shape, bool)
    for first in range(0, len(bits), PANEL):
        rows = slice(first, first + PANEL)
        mine = size[rows, None]
        apart = odd[rows, None] + odd[None, :] - 2 * both[rows].astype(np.int64)
        near[rows] = apart * (100 + percent) <= (100 - percent) * (mine + size[None, :])
        near[rows] &= 100 * np.minimum(mine, size[None, :]) >= percent * np.maximum(mine, size[None, :])
    return near


def stars(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A member of each component of a symmetric relation, and others of it, until all are named."""
    left = np.ones(len(near), bool)
    for start in range(len(near)):
        if left[start]:
            left[start] = False
            reached = np.array([start])
            while len(reached):
                reached = np.flatnonzero(near[reached].any(axis=0) & left)
                left[reached] = False
                if len(reached):
                    yield start, reached


def _tied_sketches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for group in by_group(batches, _CELL):
            if group.num_rows < 2:
                continue
            bits = [np.frombuffer(b, np.uint8) for b in group["bits"].to_pylist()]
            near = near_sketches(bits, group["n"].to_numpy().astype(np.int64), percent)
            names = group["e"].combine_chunks()
            for start, others in stars(near):
                at = pa.array(others)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(others), start))), names.take(at)], names=["a", "b"])

    return run


def thinned(source: DataFrame, found: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """``found`` (candidates) with clusters beyond ``block`` refined by sketches; classes that are near no other leave."""
    weighed = durable(_weighed(found))
    large = weighed.filter(F.col("met") > block).drop("met")
    if large.isEmpty():
        return weighed.drop("met")
    bits = durable(_sketches(_texts(source, large), n))
    steps = _stepped(_weighed(large, SKETCHED), percent, 0, SKETCHED).select("e", "n", "cluster", "met").join(bits, "e")
    cells = block_cells(steps, "met", max(2, block // 2), "e").repartition(*_CELL).sortWithinPartitions(*_CELL)
    ties = cells.select("e", "n", "bits", *_CELL).mapInArrow(_tied_sketches(percent), "a binary, b binary")
    finer = _clusters(ties).join(large.drop("cluster"), "e")
    return weighed.filter(F.col("met") <= block).drop("met").unionByName(finer)


def shared_tokens(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values that occur twice and more, in order, and their owners; taken by ranges to bound the memory."""
    ranges = 1 + len(values) // (1 << 20)
    part = (values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    numbers, owners, top = [], [], 0
    for k in range(ranges):
        here = part == k
        _, number, count = np.unique(values[here], return_inverse=True, return_counts=True)
        shared = count[number] > 1
        _, number = np.unique(number[shared], return_inverse=True)
        order = np.argsort(number, kind="stable")
        numbers.append((number[order] + top).astype(np.int64))
        owners.append(owner[here][shared][order].astype(np.int32))
        top += int(number.max()) + 1 if len(number) else 0
    return np.concatenate(numbers), np.concatenate(owners)


def intersections(number: np.ndarray, owner: np.ndarray, m: int, first: int, last: int) -> np.ndarray:
    """Sizes of the intersections of the sets first..last with all m sets."""
    total = np.zeros((last - first, m), np.float32)  # exact up to 2 ** 24 shingles
    width = max(256, (1 << 22) // max(m, 1))
    top = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, top, width):
        part = slice(*np.searchsorted(number, [at, at + width]))
        mine = owner[part]
        if not ((mine >= first) & (mine < last)).any():
            continue
        x = np.zeros((m, min(width, top - at)), np.float32)
        x[mine, number[part] - at] = 1
        total += x[first:last] @ x.T
    return total


def _links(sets: list[np.ndarray], places: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that are similar enough, among those that share prefix tokens under all orders."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    tokens = []
    for order in range(len(SEEDS)):
        parts = [prefix(s, p, order, percent) for s, p in zip(sets, places)]
        tokens.append(shared_tokens(np.concatenate(parts), np.repeat(np.arange(m), [len(p) for p in parts])))
    whole = None
    for first in range(0, m, PANEL):
        last = min(m, first + PANEL)
        mine = size[first:last, None]
        open_ = 100 * np.minimum(mine, size[None, :]) >= percent * np.maximum(mine, size[None, :])
        open_ &= np.arange(m)[None, :] > np.arange(first, last)[:, None]
        for number, own in tokens:
            if open_.any():
                open_ &= intersections(number, own, m, first, last) > 0
        if not open_.any():
            continue
        if whole is None:
            whole = shared_tokens(np.concatenate(sets), owner)
        # the sets themselves only of members with a candidate
        some = np.flatnonzero(open_.any(axis=0) | np.isin(np.arange(m), np.flatnonzero(open_.any(axis=1)) + first))
        place = np.full(m, -1)
        place[some] = np.arange(len(some))
        kept = place[whole[1]] >= 0
        lo, hi = np.searchsorted(some, [first, last])
        common = intersections(whole[0][kept], place[whole[1][kept]], len(some), lo, hi)
        n, k = size[some[lo:hi]][:, None], size[some][None, :]
        a, b = np.nonzero(open_[np.ix_(some[lo:hi] - first, some)] & (100 * common.astype(np.int64) >= percent * (n + k - common.astype(np.int64))))
        yield some[lo + a], some[b]


def _cells(batches: Iterator[pa.RecordBatch], ranks: Ranks, n: int) -> Iterator[tuple]:
    """Classes, sets, their ranks and facts of each cell of consecutive rows; a text goes once its set is there."""
    last, held, met = None, [], set()
    for batch in batches:
        keys = [tuple(k) for k in zip(*(batch.column(c).to_pylist() for c in _CELL))]
        names = batch.column("e").to_pylist()
        facts = list(zip(*(batch.column(c).to_pylist() for c in ("_side", "_home", "copies"))))
        for first, _, data, offsets in blocks(batch.column("text")):
            for at, (own, rank) in enumerate(shingle_sets(data, offsets, n, ranks), first):
                if keys[at] != last:
                    if len(held) > 1:
                        yield last, held
                    last, held, met = keys[at], [], set()
                # two texts with equal marks under one id: only one is the class's; repeated rows bring a class twice
                if names[at] not in met and _digest(own) == names[at]:
                    met.add(names[at])
                    held.append((names[at], own, rank, facts[at]))
        del batch, data
    if len(held) > 1:
        yield last, held


def _verify(ranks: Ranks, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for (_, i, j), held in _cells((b for b in batches if b.num_rows), ranks, n):
            expected, sets, places = ([h[k] for h in held] for k in range(3))
            side, home, copies = (np.array([h[3][k] for h in held]) for k in range(3))
            links = np.zeros(len(sets), np.int64)
            across = i != j
            forest, tree = Forest(len(sets)), []
            for a, b in _links(sets, places, percent):
                if across:
                    a, b = a[side[a] != side[b]], b[side[a] != side[b]]
                here = home[a] | home[b]
                np.add.at(links, a[here], copies[b[here]])
                np.add.at(links, b[here], copies[a[here]])
                tree += [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.join(x, y)]
            linked = np.flatnonzero(links)
            if tree or len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([expected[x] for x, _ in tree] + [expected[x] for x in linked], pa.binary()),
                     pa.array([expected[y] for _, y in tree] + [None] * len(linked), pa.binary()),
                     pa.array([None] * len(tree) + links[linked].tolist(), pa.int64())], names=["a", "b", "links"])

    return run


def near_copies(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text), n_shingles, component_id, n_links, kept.

    n_links counts the other documents (rows) that are similar enough to the document itself.
    """
    source = _source(docs, id_col, text_col)
    ranks = count_ranks(source, n)
    own = durable(_classes(source, n))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    lowest = own.filter("n > 0").groupBy("e").agg(F.min(order).alias("low"), F.first("n").alias("n"), F.sum("copies").alias("copies"))
    found = thinned(source, candidates(source, own, ranks, n, percent), n, percent, block)
    wanted = durable(_stepped(_weighed(found), percent, block))
    texts = _texts(source, wanted)
    cells = block_cells(texts.select("e", "cluster", "met", "copies", "_home", "text"), "met", block, "e")
    cells = cells.repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j", "e")
    links = durable(cells.mapInArrow(_verify(ranks, n, percent), "a binary, b binary, links long"))
    counts = links.filter("links is not null").groupBy(F.col("a").alias("e")).agg(F.sum("links").alias("links"))
    roots = components(links.filter("links is null").select("a", "b")).select(F.col("node").alias("e"), "root")

    verdict = lowest.join(roots, "e", "left").join(counts, "e", "left").withColumn("root", F.coalesce("root", "e"))
    best = verdict.groupBy("root").agg(F.min("low").alias("best"))
    verdict = verdict.join(best, "root").select("e", "best", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # back over salted parts, so that the copies of a hot class are spread
    salted = own.withColumn("salt", F.pmod(F.xxhash64("mark", "doc_id"), F.lit(32)).cast("int"))
    parts = salted.filter("n > 0").select("e", "salt").distinct().join(verdict, "e")
    out = salted.join(parts, ["e", "salt"], "left")
    out = out.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    return out.select("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      ((F.col("n") == 0) | ((me == F.col("best")) & (F.col("_turn") == 1))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay: one of each component, and all without shingles; columns as in ``docs``."""
    stay = (near_copies(docs, id_col=id_col, text_col=text_col, **options).filter("kept").groupBy("doc_id", "mark")
            .agg(F.count(F.lit(1)).alias("times")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"))
    found = rows.join(stay, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")))
    turn = F.row_number().over(W.partitionBy("_id", "_mark").orderBy("_mark"))
    return found.withColumn("_turn", turn).filter("_turn <= times").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op1_ngram_join")
def op1(spark, folder):
    return near_copies(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
