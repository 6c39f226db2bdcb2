"""Best-fit packing by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut from their end, so that every piece but the first is
full. The other pieces are dealt by hash into shards of bounded size. Each shard is packed by
several islands: a population starts from best fits in differing orders; a crossover injects whole
well-filled bins of one parent into the other, removes the bins that now hold an item twice, and
best-fits the displaced items; after each round every island sends its elite to its neighbour. At
the end the shards' poorly filled bins are opened and packed once more together.

Results for odd input: a null or empty text is the closing id alone; rows that repeat an id are
packed as separate documents; null ids stay null; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .registry import query, table
from .textblocks import plain

CAPACITY = 1024
CLOSING = 2
SHARD_ITEMS = 4096
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 12  # per round
POPULATION = 6


# -- pieces -------------------------------------------------------------------------------

def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    closing = np.asarray([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import file_tokens

        encode = file_tokens(tokenizer).encode
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(plain(batch.column("text"))):
                ids = encode(text.as_py()) + closing
                n, a, k = len(ids) // 4, 0, 0
                b = (n - 1) % capacity + 1
                while a < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# -- one island ---------------------------------------------------------------------------

def best_fit(sizes, order, place: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the items of ``order`` into the fullest bin that takes them; ``room`` is what bins have left."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            open_at[r].append(b)
            mask |= 1 << r
    for i in order:
        s = sizes[i]
        fitting = mask >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        left = r - s
        room[b] = left
        place[i] = b
        if left:
            open_at[left].append(b)
            mask |= 1 << left


class Island:
    """Packings of one shard; a packing is the bin of each item and what each bin has left."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.plain_sizes = sizes.tolist()
        self.rng = np.random.default_rng(seed)
        self.bound = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
        self.population: list[tuple[float, np.ndarray, np.ndarray]] = []

    def add(self, place: np.ndarray) -> None:
        """Take in a packing, its bins renumbered, and drop the worst beyond the population's size."""
        used, place = np.unique(place, return_inverse=True)
        room = self.capacity - np.bincount(place, weights=self.sizes, minlength=len(used)).astype(np.int64)
        # fewer bins first, then emptier emptiest bins
        cost = len(used) - float(np.mean((1 - room / self.capacity) ** 2)) if len(used) else 0.0
        if all(cost != c for c, _, _ in self.population):
            self.population.append((cost, place, room))
            self.population.sort(key=lambda p: p[0])
            del self.population[POPULATION:]

    def fresh(self, noise: float) -> None:
        keys = self.sizes * (1 + noise * self.rng.random(len(self.sizes)))
        place, room = np.zeros(len(self.sizes), np.int64), []
        best_fit(self.plain_sizes, np.argsort(-keys, kind="stable").tolist(), place, room, self.capacity)
        self.add(place)

    def crossover(self, mine, other) -> np.ndarray:
        _, place, room = mine
        _, gifts, gift_room = other
        rank = gift_room + self.rng.random(len(gift_room)) * self.capacity / 16
        chosen = np.zeros(len(gift_room), bool)
        chosen[np.argsort(rank)[:max(1, int(len(rank) * self.rng.uniform(0.2, 0.6)))]] = True
        given = chosen[gifts]
        struck = np.zeros(len(room), bool)
        struck[place[given]] = True
        # a few of the emptiest bins are opened as well
        struck[np.argsort(-(room + self.rng.random(len(room)) * 8))[:max(1, len(room) // 50)]] = True
        loose = np.flatnonzero(struck[place] & ~given)
        made, left = place.copy(), np.where(struck, 0, room).tolist()
        number = np.cumsum(chosen) - 1 + len(left)
        made[given] = number[gifts[given]]
        left += gift_room[chosen].tolist()
        loose = loose[np.argsort(-self.sizes[loose], kind="stable")]
        best_fit(self.plain_sizes, loose.tolist(), made, left, self.capacity)
        return made

    def evolve(self, generations: int) -> np.ndarray:
        for noise in (0.0, 0.05, 0.2, 0.6)[:max(0, POPULATION - len(self.population))]:
            self.fresh(noise)
        for _ in range(generations):
            best = self.population[0]
            if len(best[2]) <= self.bound or len(self.population) < 2:
                break
            a, b = self.rng.choice(len(self.population), 2, replace=False)
            self.add(self.crossover(self.population[min(a, b)], self.population[max(a, b)]))
            self.add(self.crossover(self.population[max(a, b)], self.population[min(a, b)]))
        return self.population[0][1]


# -- all islands --------------------------------------------------------------------------

def pack_items(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
               rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """uid, length, bin from uid, length: bin is the smallest uid of the bin's items."""
    items = items.select("uid", "length")
    shards = max(1, math.ceil(items.count() / shard_items))
    state = items.select(
        F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "length",
        F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("guest"))
    schema = "shard long, island int, uid long, length long, own long, bins long"

    def turn(number: int):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("uid", ignore_index=True)
            pool = Island(rows["length"].to_numpy(np.int64), capacity, hash((int(key[0]), int(key[1]), number, seed)) & 0x7FFFFFFF)
            for name in ("own", "guest"):
                known = rows[name].to_numpy(np.int64)
                if len(known) and known[0] >= 0:
                    pool.add(known)
            best = pool.evolve(GENERATIONS)
            return pd.DataFrame({"shard": rows["shard"], "island": rows["island"], "uid": rows["uid"],
                                 "length": rows["length"], "own": best, "bins": int(best.max()) + 1})

        return run

    for number in range(rounds):
        done = durable(state.groupBy("shard", "island").applyInPandas(turn(number), schema))
        if number + 1 < rounds:
            guests = done.select("shard", ((F.col("island") + 1) % islands).alias("island"), "uid", F.col("own").alias("guest"))
            state = done.drop("bins").join(guests, ["shard", "island", "uid"])
    best = (done.groupBy("shard", "island").agg(F.first("bins").alias("bins"))
            .groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", F.col("best.island").alias("island")))
    chosen = done.join(best, ["shard", "island"])
    group = W.partitionBy("shard", "own")
    return chosen.select("uid", "length", F.min("uid").over(group).alias("bin"), F.sum("length").over(group).alias("fill"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **cols) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = durable(pieces(docs, tokenizer, capacity, **cols).withColumn("uid", F.monotonically_increasing_id()))
    first = durable(pack_items(cut.filter(F.col("length") < capacity), capacity))
    # bins that the shards left poorly filled are packed together
    poor = F.col("fill") < capacity - capacity // 64
    again = pack_items(first.filter(poor), capacity, seed=1)
    placed = first.filter(~poor).select("uid", "length", "bin").unionByName(again.select("uid", "length", "bin"))
    before = W.partitionBy("bin").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select("uid", F.col("bin").alias("sequence_id"),
                           F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    whole = cut.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity).join(placed, "uid")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return whole.select(*names).unionByName(rest.select(*names))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def op5(spark, folder):
    return pack(table(spark, folder, "documents"), public_tokenizer())
