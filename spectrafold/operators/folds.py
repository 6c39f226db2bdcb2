"""Cross-validation folds as row-local columns.

A fold depends on the 0-based position, the row count and the settings, so it is an expression,
not a table to join: shuffled strategies use a keyed permutation of the positions. Only
stratified folds (rank within a class) and the bootstrap (draws) shuffle rows.

Every strategy yields ``test_folds`` and ``train_folds`` (arrays of fold numbers; weights for the
bootstrap). Strategies that test each row once also set ``fold``, and training sets are then
total minus fold.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import class_layer
from .ordering import permutations, permuted, rank_within

PARTITIONS = ("kfold", "stratified_kfold", "venetian_blinds", "loocv")


@dataclass(frozen=True)
class CV:
    strategy: str = "kfold"
    k: int = 5
    seed: int = 42
    shuffle: bool = True
    window: int | None = None
    repeats: int = 10
    test_size: float = 0.2
    layer: int = 1
    metrics: tuple[str, ...] = ("rmse", "r2")

    def describe(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in asdict(self).items() if v is not None)

    @property
    def partitions(self) -> bool:
        return self.strategy in PARTITIONS


def moving_window_plan(n: int, k: int, window: int | None) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) per fold."""
    w = max(1, n // (k + 2)) if window is None else window
    if k < 1 or w >= n:
        raise ValueError("moving window needs k >= 1 and a window below the sample count")
    test = max(1, (n - w) // (k + 1))
    last = max(0, n - w - test)
    step = max(1, last // max(1, k - 1))
    plan = []
    for f in range(k):
        start = min(f * step, last)
        if start + w < n:
            plan.append((start, start + w, start + w, min(start + w + test, n)))
    return plan


def time_plan(n: int, k: int) -> list[tuple[int, int, int, int]]:
    if k + 1 > n:
        raise ValueError("more splits than samples allow")
    t = n // (k + 1)
    return [(0, n - (k - f) * t, n - (k - f) * t, n - (k - f - 1) * t) for f in range(k)]


def block_fold(at, n: int, k: int):
    """Contiguous folds; the first n mod k have one row more."""
    q, r = divmod(n, k)
    head = r * (q + 1)
    return F.when(at < head, F.floor(at / (q + 1))).otherwise(
        F.lit(r) + F.floor((at - head) / max(q, 1))).cast("int")


def _others(fold, k: int):
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != fold)


def _within(plan, side: int, at):
    hits = [F.when((at >= p[side]) & (at < p[side + 1]), F.lit(f)) for f, p in enumerate(plan)]
    return F.array_compact(F.array(*hits))


def quantile_bins(df: DataFrame, k: int) -> DataFrame:
    """Class labels for stratifying a regression: quantile bins of the first response."""
    from .stats import exact_quantiles
    bins = min(max(k, 2), 10)
    y = df.select(F.lit(0).alias("pos"), F.get("y", F.lit(0)).alias("value"))
    edges = sorted(set(exact_quantiles(y, [i / bins for i in range(1, bins)])[(0,)]))
    number = sum((F.get("y", F.lit(0)) >= F.lit(e)).cast("int") for e in edges)
    return df.withColumn("_class", number.cast("string"))


def assign(df: DataFrame, cv: CV, n: int | None = None, ix: str = "ix") -> DataFrame:
    """Add the fold columns. Positions must be dense; ``n`` spares counting them."""
    if n is None:
        n = df.agg(F.max(ix).alias("m")).first()["m"] + 1
    at = F.col(ix)
    s, k = cv.strategy, cv.k
    if s in ("kfold", "stratified_kfold", "venetian_blinds", "repeated_kfold") and not 2 <= k <= n:
        raise ValueError(f"{s} needs 2 <= k <= {n}")
    if s == "kfold":
        # dealing a permutation out gives the same fold sizes as cutting it
        fold = (permuted(at, n, cv.seed) % k).cast("int") if cv.shuffle else block_fold(at, n, k)
    elif s == "venetian_blinds":
        fold = (at % k).cast("int")
    elif s == "loocv":
        fold = at
    elif s == "stratified_kfold":
        return _stratified(df, cv, ix)
    else:
        return _overlapping(df, cv, n, at)
    df = df.withColumn("fold", fold)
    if s == "loocv":  # one fold per row: membership lists would be n² long
        return df
    return (df.withColumn("test_folds", F.array("fold")).withColumn("train_folds", _others(F.col("fold"), k)))


def _stratified(df: DataFrame, cv: CV, ix: str) -> DataFrame:
    """Deal each class over the folds in (shuffled) order, starting where the last class ended."""
    if "classes" in df.columns:
        df = df.withColumn("_class", class_layer(cv.layer))
    elif "y" in df.columns:
        df = quantile_bins(df, cv.k)
    else:
        raise ValueError("stratified folds need classes or a response")
    order = [F.xxhash64(F.lit(cv.seed), ix), F.col(ix)] if cv.shuffle else [F.col(ix)]
    ranked = rank_within(df, "_class", order, "_rank")
    fold = (F.col("_rank") % cv.k).cast("int")
    return (ranked.withColumn("fold", fold).withColumn("test_folds", F.array("fold"))
            .withColumn("train_folds", _others(F.col("fold"), cv.k)).drop("_class", "_rank"))


def _overlapping(df: DataFrame, cv: CV, n: int, at) -> DataFrame:
    s, k = cv.strategy, cv.k
    if s in ("timeseries", "moving_window"):
        plan = time_plan(n, k) if s == "timeseries" else moving_window_plan(n, k, cv.window)
        return df.withColumn("test_folds", _within(plan, 2, at)).withColumn("train_folds", _within(plan, 0, at))
    if s == "repeated_kfold":
        # fold number = repeat * k + fold inside the repeat
        places = permutations(at, n, [cv.seed + r for r in range(cv.repeats)])
        every = F.sequence(F.lit(0), F.lit(k * cv.repeats - 1))
        df = df.withColumn("_at", places)
        own = F.transform("_at", lambda p, r: (r * k + p % k).cast("int"))
        return (df.withColumn("test_folds", own)
                .withColumn("train_folds", F.array_except(every, F.col("test_folds"))).drop("_at"))
    if s == "shuffle_split":
        held = math.ceil(n * cv.test_size)
        every = F.sequence(F.lit(0), F.lit(k - 1))
        df = df.withColumn("_at", permutations(at, n, [cv.seed + f for f in range(k)]))
        return (df.withColumn("test_folds", F.filter(every, lambda f: F.get("_at", f) < held))
                .withColumn("train_folds", F.filter(every, lambda f: F.get("_at", f) >= held)).drop("_at"))
    if s == "bootstrap":
        return _bootstrap(df, cv, n, at)
    raise ValueError(f"unknown strategy {s}")


def _bootstrap(df: DataFrame, cv: CV, n: int, at) -> DataFrame:
    """n draws with replacement per split; rows never drawn are that split's test rows."""
    draws = df.sparkSession.range(n * cv.k).select((F.col("id") % cv.k).cast("int").alias("f"),
                                                   F.floor(F.col("id") / cv.k).alias("j"))
    counted = (draws.select("f", F.pmod(F.xxhash64(F.lit(cv.seed), "f", "j"), F.lit(n)).alias("_ix"))
               .groupBy("_ix", "f").count())
    per_row = (counted.groupBy("_ix").agg(F.array_sort(F.collect_list(
        F.struct("f", F.col("count").cast("double").alias("w")))).alias("_drawn")))
    joined = df.join(per_row, at == F.col("_ix"), "left")
    drawn = F.coalesce(F.col("_drawn"), F.array().cast("array<struct<f:int,w:double>>"))
    every = F.sequence(F.lit(0), F.lit(cv.k - 1))
    return (joined.withColumn("train_folds", F.transform(drawn, lambda d: d["f"]))
            .withColumn("train_weights", F.transform(drawn, lambda d: d["w"]))
            .withColumn("test_folds", F.array_except(every, F.col("train_folds")))
            .drop("_ix", "_drawn"))


def training_rows(assigned: DataFrame) -> DataFrame:
    """One row per (sample, training fold) with ``fold`` and ``weight``."""
    weights = F.col("train_weights") if "train_weights" in assigned.columns else \
        F.transform("train_folds", lambda _: F.lit(1.0))
    rest = [c for c in assigned.columns if c not in ("fold", "train_folds", "test_folds", "train_weights")]
    return (assigned.select(*rest, F.explode(F.arrays_zip(F.col("train_folds").alias("f"),
                                                         weights.alias("w"))).alias("_t"))
            .select(*rest, F.col("_t.f").alias("fold"), F.col("_t.w").alias("weight")))


def test_rows(assigned: DataFrame) -> DataFrame:
    """One row per (sample, fold that tests it)."""
    rest = [c for c in assigned.columns if c not in ("fold", "train_folds", "test_folds", "train_weights")]
    return assigned.select(*rest, F.explode("test_folds").alias("fold"))


def fold_table(assigned: DataFrame, ix: str = "ix") -> DataFrame:
    """Membership rows (fold, ix, role, weight)."""
    if "test_folds" not in assigned.columns:
        return assigned.select(F.col("fold"), ix, F.lit("test").alias("role"), F.lit(1.0).alias("weight"))
    train = training_rows(assigned).select("fold", ix, F.lit("train").alias("role"), "weight")
    test = test_rows(assigned).select("fold", ix, F.lit("test").alias("role"), F.lit(1.0).alias("weight"))
    return train.unionByName(test)


def cross_validate(df: DataFrame, cv: CV, fit, predict, n: int | None = None, ix: str = "ix") -> DataFrame:
    """User hook: ``fit(training rows) -> model`` and ``predict(model, test rows) -> DataFrame`` per fold.

    Returns the union of the predictions with ``fold``. Training rows carry ``weight`` (above 1
    for rows the bootstrap drew more than once). Folds without rows on either side are left out.
    """
    if cv.strategy == "loocv":
        raise ValueError("one fit per row: choose folds for a user model")
    assigned = assign(df, cv, n, ix)
    train, test = training_rows(assigned), test_rows(assigned)
    sizes = {r["fold"]: r for r in fold_table(assigned, ix).groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test")).collect()}
    out = None
    for f in sorted(sizes):
        if not sizes[f]["train"] or not sizes[f]["test"]:
            continue
        model = fit(train.filter(F.col("fold") == f).drop("fold"))
        part = predict(model, test.filter(F.col("fold") == f).drop("fold")).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out
