"""Calibration/validation splits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrays import block, column_of, vector
from ..dataset import Dataset, class_layer
from ..session import Spool, durable
from .neighbors import _WORK_BYTES, Metric, _Rough
from .ordering import permuted, rank_within

_POOL = 4096             # candidates per pass and group that reach the driver
_POOL_BYTES = 64 << 20   # and of all groups, unless they are few
_PICKS = 4096            # picks per pass that every row is compared with
_KEPT = 8                # passes whose state is held by executors alone, before one is checkpointed


def quotas(counts: dict, select: int) -> dict:
    """Largest-remainder shares of ``select``; the order of ``counts`` breaks ties."""
    n = sum(counts.values())
    exact = {k: c * (select / n) for k, c in counts.items()}
    share = {k: math.floor(v) for k, v in exact.items()}
    left = select - sum(share.values())
    for k in sorted(exact, key=lambda k: -(exact[k] - share[k])):
        if left <= 0:
            break
        if share[k] < counts[k]:
            share[k] += 1
            left -= 1
    return share


def quota_table(df: DataFrame, group: str, select: int) -> DataFrame:
    """Quotas as a DataFrame; one row per class goes through the ranking window."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"]
    exact = F.col("n") * (F.lit(float(select)) / F.lit(float(total)))
    shares = counts.withColumn("base", F.floor(exact).cast("long")).withColumn("part", exact - F.floor(exact))
    left = select - shares.agg(F.sum("base").alias("s")).first()["s"]
    rank = F.row_number().over(W.orderBy(F.col("part").desc(), F.col(group)))
    return shares.select(group, "n", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("quota"))


def _mark(ds: Dataset, chosen) -> Dataset:
    return ds.with_df(ds.df.withColumn("split", F.when(chosen, "cal").otherwise("val")))


def random_split(ds: Dataset, fraction: float, seed: int = 42) -> Dataset:
    """Exactly int(n·fraction) calibration rows, row-locally: needs dense positions only."""
    n = ds.df.agg(F.max("ix").alias("m")).first()["m"] + 1
    return _mark(ds, permuted("ix", n, seed) < int(n * fraction))


def stratified_split(ds: Dataset, fraction: float, seed: int = 42, layer: int = 1) -> Dataset:
    """Random split with per-class quotas."""
    df = ds.df.withColumn("_class", class_layer(layer))
    counts = {r["_class"]: r["count"] for r in df.groupBy("_class").count().orderBy("_class").collect()}
    share = quotas(counts, int(sum(counts.values()) * fraction))
    ranked = rank_within(df, "_class", [F.xxhash64(F.lit(seed), "ix"), "ix"], "_rank")
    table = df.sparkSession.createDataFrame(list(share.items()), "_class string, _quota long")
    marked = _mark(ds.with_df(ranked.join(table, "_class", "left")), F.col("_rank") < F.col("_quota"))
    return ds.with_df(marked.df.drop("_class", "_rank", "_quota"))


def kennard_stone(df: DataFrame, select: int | dict, group: str | None = None, x: str = "x") -> DataFrame:
    """Max-min distance selection; returns (group, round, ix) of the picks in order.

    Starts at the sample farthest from the mean. Every pass brings a fixed number of the most
    distant rows to the driver and takes as many picks from them as are certain: distances only
    shrink, so a pool row that still beats the bound of all rows outside the pool is the next
    pick. The passes over the table are therefore far fewer than the picks, and the result is
    the sequential one. ``min_d`` is carried in a persisted table that is checkpointed every ``_KEPT`` passes, so
    that the lineage stays short and few passes are written.
    """
    work = df.select(F.col("ix"), F.col(x).alias("x"),
                     (F.col(group).cast("string") if group else F.lit("")).alias("g"))
    wanted = select if isinstance(select, dict) else None
    if wanted is None:
        counts = {r["g"]: r["count"] for r in work.groupBy("g").count().orderBy("g").collect()}
        wanted = quotas(counts, select)
    wanted = {str(k): v for k, v in wanted.items()}
    means = _group_means(work)
    state = durable(_with_distance(work, means))
    usable = {r["g"]: r["count"] for r in state.groupBy("g").count().collect()}
    if any(n > usable.get(g, 0) for g, n in wanted.items()):
        raise ValueError("fewer samples without missing values than are to be selected")
    taken = {g: 0 for g in wanted}
    width = max((len(m) for m in means.values()), default=1)
    size = min(_POOL, max(512, _POOL_BYTES // (8 * max(1, width * len(wanted)))))
    passes, held = 0, None
    spool = Spool(df.sparkSession, "grp string, round int, ix long")
    while any(taken[g] < wanted[g] for g in wanted):
        fresh: dict[str, list] = {}
        pool = _top_rows(state.filter(F.col("g").isin([g for g in wanted if taken[g] < wanted[g]])), size)
        if held is not None:
            held.unpersist()
        first = {g: not taken[g] for g in wanted}
        for g, rows in pool.items():
            fresh[g] = _certain_picks(rows, wanted[g] - taken[g], first[g], size)
        spool.add([(g, taken[g] + i, int(ix)) for g, rows in fresh.items() for i, (ix, _) in enumerate(rows)])
        for g, rows in fresh.items():
            taken[g] += len(rows)
        if any(taken[g] < wanted[g] for g in wanted):
            passes += 1
            held = state
            shrunk = _shrink(state, {g: np.array([v for _, v in rows]) for g, rows in fresh.items()}, first,
                             {g: [ix for ix, _ in rows] for g, rows in fresh.items()})
            state = durable(shrunk) if passes % _KEPT == 0 else shrunk.persist()
    state.unpersist()
    return spool.frame()


def _group_means(work: DataFrame) -> dict[str, np.ndarray]:
    rows = (work.select("g", F.posexplode("x").alias("pos", "v")).groupBy("g", "pos")
            .agg(F.avg("v").alias("m")).orderBy("g", "pos").collect())
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["g"], []).append(r["m"])
    return {g: np.array(v) for g, v in out.items()}


def _rewrite(work: DataFrame, fn) -> DataFrame:
    """Rows (ix, x, g, d) with ``fn(batch columns) -> d`` (NaN leaves the row out)."""
    schema = "ix long, x array<double>, g string, d double"

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = fn(batch)
            made = pa.RecordBatch.from_arrays(
                [batch.column("ix"), batch.column("x"), batch.column("g"), pa.array(d)],
                names=["ix", "x", "g", "d"])
            yield made.filter(pa.array(~np.isnan(d)))

    return work.mapInArrow(run, schema)


def _with_distance(work, means):
    def start(batch):
        z = block(batch.column("x"))
        groups = np.array(batch.column("g").to_pylist())
        return np.linalg.norm(z - np.stack([means[g] for g in groups]), axis=1)

    return _rewrite(work, start)


def _shrink(state, added, is_first, gone):
    """min(d, distance to the new picks); the first picks replace the start distance."""
    picks = state.sparkSession.sparkContext.broadcast((added, gone))

    def update(batch):
        points_of, taken_of = picks.value
        z = block(batch.column("x"))
        ix = vector(batch.column("ix"))
        groups = np.array(batch.column("g").to_pylist())
        d = vector(batch.column("d")).copy()
        for g, points in points_of.items():
            rows = np.flatnonzero(groups == g)
            if not len(rows):
                continue
            d[rows] = _least(z[rows], points, np.full(len(rows), np.inf) if is_first[g] else d[rows])
            taken = np.isin(ix[rows], taken_of[g])
            d[rows[taken]] = np.nan
        return d

    return _rewrite(state, update)


def _least(z: np.ndarray, points: np.ndarray, d: np.ndarray) -> np.ndarray:
    """min(d, least distance to the points). Only pairs that quick keys can't rule out are measured by differences."""
    d = d.copy()
    if not len(points):
        return d
    if not np.isfinite(d).all() or max(np.abs(z).max(initial=0), np.abs(points).max(initial=0)) > 1e150:
        for point in points:
            d = np.minimum(d, np.linalg.norm(z - point, axis=1))
        return d
    rough = _Rough(Metric(), z, points, True)
    step, tile = rough.steps
    size = max(1, _WORK_BYTES // (8 * z.shape[1]))
    for a in range(0, len(z), step):
        to = min(a + step, len(z))
        for b in range(0, len(points), tile):
            i, at, _ = rough.within(a, to, b, min(b + tile, len(points)), rough.of(d[a:to], a, to))
            for c in range(0, len(i), size):
                far = np.linalg.norm(z[i[c:c + size] + a] - points[at[c:c + size] + b], axis=1)
                np.minimum.at(d, i[c:c + size] + a, far)
    return d


def _top_rows(state: DataFrame, size: int) -> dict[str, list]:
    """The ``size`` most distant rows per group and the next one (ties by position).

    Distances and positions tell the last of them; only then rows move.
    """
    def best(batches, columns, fits):
        held: dict[str, list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = np.array(batch.column("g").to_pylist())
            given = [block(batch.column(c)) if c == "x" else vector(batch.column(c)) for c in columns]
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                at = at[fits(g, given[0][at], given[1][at])]
                own = [v[at] for v in given]
                if g in held:
                    own = [np.concatenate(pair) for pair in zip(held[g], own)]
                order = np.lexsort((own[1], -own[0]))[:size + 1]
                held[g] = [v[order] for v in own]
        for g, own in held.items():
            if len(own[0]):
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own[0])), *[column_of(v) for v in own]], names=["g", *columns])

    def ranks(batches):
        yield from best(batches, ["d", "ix"], lambda g, d, ix: slice(None))

    rows = state.mapInArrow(ranks, "g string, d double, ix long")
    # narrow in two steps, so that no task sees the best rows of every other task
    for part in (["g", F.pmod(F.xxhash64("ix"), F.lit(256))], ["g"]):
        w = W.partitionBy(*part).orderBy(F.col("d").desc(), "ix")
        rows = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size + 1)
    edges = {r["g"]: (r["d"], r["ix"]) for r in rows.filter(F.col("r") == size + 1).collect()}

    def chosen(batches):
        def fits(g, d, ix):
            if g not in edges:
                return slice(None)
            far, last = edges[g]
            return (d > far) | ((d == far) & (ix <= last))

        yield from best(batches, ["d", "ix", "x"], fits)

    table = state.mapInArrow(chosen, "g string, d double, ix long, x array<double>").toArrow()
    out: dict[str, list] = {}
    if table.num_rows:
        groups, d, ix, z = np.array(table["g"].to_pylist()), vector(table["d"]), vector(table["ix"]), block(table["x"])
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            at = at[np.lexsort((ix[at], -d[at]))][:size + 1]
            out[str(g)] = [(int(ix[k]), z[k], d[k]) for k in at]
    return out


def _certain_picks(rows, need: int, first: bool, size: int) -> list:
    """Picks that rows outside the pool cannot beat."""
    complete = len(rows) <= size
    pool = rows[:size]
    if not pool:
        return []
    bound = -np.inf if complete else rows[size][2]
    edge = None if complete else rows[size][0]
    ix = np.array([r[0] for r in pool])
    z = np.stack([r[1] for r in pool])
    d = np.array([r[2] for r in pool])
    chosen = []
    if first:  # farthest from the mean; afterwards distances to picks replace it
        at = _farthest(d, ix)
        chosen.append((int(ix[at]), z[at]))
        if not complete:
            return chosen
        d = np.linalg.norm(z - z[at], axis=1)
        d[at] = -np.inf
    while len(chosen) < min(need, _PICKS):
        if len(chosen) % 32 == 31:  # what has fallen below the bound is no pick of this pass
            left = (d >= bound) & (d > -np.inf)
            ix, z, d = ix[left], z[left], d[left]
            if not len(d):
                break
        at = _farthest(d, ix)
        if d[at] == -np.inf or d[at] < bound or (d[at] == bound and edge is not None and ix[at] > edge):
            break
        chosen.append((int(ix[at]), z[at]))
        d = np.minimum(d, np.linalg.norm(z - z[at], axis=1))
        d[(ix == ix[at]) | (ix == chosen[0][0])] = -np.inf
    return chosen


def _farthest(d: np.ndarray, ix: np.ndarray) -> int:
    """The place of the greatest distance, the lowest position among equal ones."""
    ties = np.flatnonzero(d == d.max())
    return int(ties[np.argmin(ix[ties])])


def kennard_stone_split(ds: Dataset, fraction: float, layer: int | None = None) -> Dataset:
    df = ds.df.withColumn("_class", class_layer(layer)) if layer else ds.df
    n = df.count()
    if layer:
        counts = {r["_class"]: r["count"] for r in df.groupBy("_class").count().orderBy("_class").collect()}
        picks = kennard_stone(df, quotas(counts, int(n * fraction)), "_class")
    else:
        picks = kennard_stone(df, int(n * fraction))
    chosen = picks.select("ix", F.lit(True).alias("_cal"))
    out = ds.df.join(chosen, "ix", "left")
    return ds.with_df(out.withColumn("split", F.when(F.col("_cal"), "cal").otherwise("val")).drop("_cal"))


def split(ds: Dataset, method: str = "random", fraction: float = 0.75, seed: int = 42, layer: int = 1,
          selection: DataFrame | None = None) -> Dataset:
    """Mark rows 'cal' or 'val'. ``selection`` has (ix, mark) with 1 = cal, 2 = val."""
    if method == "random":
        return random_split(ds, fraction, seed)
    if method == "stratified_random":
        return stratified_split(ds, fraction, seed, layer)
    if method == "kennard_stone":
        return kennard_stone_split(ds, fraction)
    if method == "stratified_kennard_stone":
        return kennard_stone_split(ds, fraction, layer)
    if method == "file":
        marked = ds.df.join(selection.select("ix", F.col("mark").alias("_mark")), "ix", "left")
        return ds.with_df(marked.withColumn("split", F.when(F.col("_mark") == 1, "cal").otherwise("val"))
                          .drop("_mark"))
    raise ValueError(f"unknown split method {method}")


def joined(cal: Dataset, val: Dataset) -> Dataset:
    """Calibration and validation rows in one frame for a joint fit."""
    return cal.with_df(cal.df.withColumn("split", F.lit("cal"))
                       .unionByName(val.df.withColumn("split", F.lit("val")), allowMissingColumns=True))
