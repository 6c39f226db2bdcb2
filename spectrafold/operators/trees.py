"""Tree ensembles: MLlib forests and boosting, extremely randomised trees, AdaBoost."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import few_tasks, map_blocks, sum_blocks
from ..session import durable

_MAX_DEPTH = 30          # the deepest tree MLlib grows
_KEEP_EVERY = 8          # boosting rounds between written row weights
_HELD_CELLS = 4 << 20    # statistics of a group of trees in one pass


def _subset(max_features) -> str:
    if max_features in (None, "", "none", 1.0):
        return "all"
    return str(max_features)


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("x"))


def _grown(model, depth: int):
    """The fitted ensemble, if MLlib's deepest tree was deep enough for the depth that was asked for."""
    reached = max(t.depth for t in model.trees)
    if reached >= _MAX_DEPTH and not 0 < depth <= _MAX_DEPTH:
        raise ValueError(f"a tree reached the {_MAX_DEPTH} levels that can be grown; ask for a depth up to {_MAX_DEPTH} or a larger min_leaf")
    return model


def _levels(depth: int) -> int:
    return min(depth, _MAX_DEPTH) if depth > 0 else _MAX_DEPTH


# --- regression ---------------------------------------------------------------------------

@dataclass(frozen=True)
class TreeRegressor:
    """One fitted MLlib model per response."""

    models: list

    def predict(self, df: DataFrame) -> DataFrame:
        out = _vectors(df)
        for j, m in enumerate(self.models):
            out = m.setPredictionCol(f"_p{j}").transform(out)
        names = [f"_p{j}" for j in range(len(self.models))]
        return out.withColumn("yhat", F.array(*names)).drop("_v", "x", *names)

    @property
    def importances(self) -> np.ndarray:
        return np.mean([m.featureImportances.toArray() for m in self.models], axis=0)


def tree_regressor(df: DataFrame, kind: str, responses: int, trees: int = 100, depth: int | None = None, min_leaf: int = 1,
                   max_features=None, learning_rate: float = 0.1, subsample: float = 1.0, max_bins: int = 255,
                   bootstrap: bool = True, seed: int = 42) -> TreeRegressor:
    """random_forest, gradient_boosting, hist_gradient_boosting or bagging.

    Depth 0 is unlimited, for gradient_boosting 1; without one boosting takes 3, histogram boosting 5 (about 31
    leaves), the others no limit. Trees that need more levels than MLlib grows are refused.
    """
    if depth is None:
        depth = {"gradient_boosting": 3, "hist_gradient_boosting": 5}.get(kind, 0)
    if kind == "gradient_boosting":
        depth = max(1, depth)
    if max_bins > 255 and kind != "hist_gradient_boosting":
        raise ValueError("at most 255 bins")
    common = dict(featuresCol="_v", minInstancesPerNode=max(1, min_leaf), seed=seed)
    deep = _levels(depth)
    data = _vectors(df.select("x", "y")).persist()
    try:
        models = []
        for j in range(responses):
            rows = data.select("_v", F.get("y", F.lit(j)).alias("label"))
            if kind in ("random_forest", "bagging"):
                model = RandomForestRegressor(
                    numTrees=max(10, trees), maxDepth=deep, subsamplingRate=subsample, bootstrap=bootstrap,
                    featureSubsetStrategy="all" if kind == "bagging" else _subset(max_features), **common)
            elif kind in ("gradient_boosting", "hist_gradient_boosting"):
                model = GBTRegressor(
                    maxIter=max(10, trees), stepSize=learning_rate, subsamplingRate=subsample,
                    maxDepth=deep,
                    maxBins=min(255, max(2, max_bins)), featureSubsetStrategy=_subset(max_features), **common)
            else:
                raise ValueError(f"unknown tree model {kind}")
            models.append(_grown(model.fit(rows), depth))
        return TreeRegressor(models)
    finally:
        data.unpersist()


# --- classification -----------------------------------------------------------------------

@dataclass(frozen=True)
class MLClassifier:
    model: object
    classes: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(k) for k in self.classes])
        out = self.model.transform(_vectors(df))
        p = vector_to_array("probability")
        return (out.withColumn("pred", F.get(names, F.col("prediction").cast("int"))).withColumn("proba", p)
                .drop("_v", "x", "rawPrediction", "probability", "prediction", "_code"))


def ml_classifier(df: DataFrame, label: str, kind: str, trees: int = 100, depth: int = 0, criterion: str = "gini",
                  min_leaf: int = 1, max_features="sqrt", c: float = 1.0, max_iter: int = 100,
                  balanced: bool = False, seed: int = 42) -> MLClassifier:
    """logistic, random_forest or bagging; class names are in sorted order.

    Depth 0 is unlimited; trees that need more levels than MLlib grows are refused.
    """
    named = df.select("x", F.col(label).cast("string").alias("_label"))
    index = StringIndexer(inputCol="_label", outputCol="_code", stringOrderType="alphabetAsc").fit(named)
    data = _vectors(index.transform(named)).persist()
    try:
        if kind == "logistic":
            counts = {r["_label"]: r["count"] for r in data.groupBy("_label").count().collect()}
            n = sum(counts.values())
            weight = reduce(lambda acc, k: acc.when(F.col("_label") == k, n / (len(counts) * counts[k]) if balanced else 1.0),
                            counts, F.when(F.lit(False), 1.0))
            model = LogisticRegression(featuresCol="_v", labelCol="_code", weightCol="_w", family="multinomial",
                                       regParam=1 / (c * n), standardization=False, maxIter=max(100, max_iter))
            fitted = model.fit(data.withColumn("_w", weight))
        elif kind in ("random_forest", "bagging"):
            fitted = RandomForestClassifier(
                featuresCol="_v", labelCol="_code", numTrees=max(10, trees), seed=seed,
                maxDepth=_levels(depth), minInstancesPerNode=max(1, min_leaf),
                impurity="gini" if criterion == "gini" else "entropy",
                featureSubsetStrategy="all" if kind == "bagging" else _subset(max_features)).fit(data)
            fitted = _grown(fitted, depth)
        else:
            raise ValueError(f"unknown classifier {kind}")
        return MLClassifier(fitted, tuple(index.labels))
    finally:
        data.unpersist()


# --- extremely randomised trees -----------------------------------------------------------

@dataclass(frozen=True)
class ExtraTrees:
    """Trees as flat arrays; leaf values are class shares or response means."""

    trees: list[dict]
    classes: tuple[str, ...] | None = None

    def leaf_means(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t["value"][_descend(t, x)] for t in self.trees], axis=0)

    def predict(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("x", "pred", "proba", "yhat")]
        if self.classes is None:
            return map_blocks(df, lambda c: {"yhat": self.leaf_means(c["x"])}, [("yhat", "array<double>")], ["x"], keep)
        names = np.array(self.classes)

        def run(c):
            p = self.leaf_means(c["x"])
            return {"pred": pa.array(names[p.argmax(1)].tolist()), "proba": p}

        return map_blocks(df, run, [("pred", "string"), ("proba", "array<double>")], ["x"], keep)


def _descend(t: dict, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        rows = np.flatnonzero(t["feature"][at] >= 0)
        if not len(rows):
            return at
        node = at[rows]
        left = x[rows, t["feature"][node]] <= t["threshold"][node]
        at[rows] = np.where(left, t["left"][node], t["left"][node] + 1)


def extra_trees(df: DataFrame, width: int, label: str | None = None, trees: int = 100, depth: int = 10,
                min_leaf: int = 1, max_features="sqrt", criterion: str = "gini", seed: int = 42) -> ExtraTrees:
    """Level by level: one pass for the range of every (tree, node, drawn feature), a random cut
    inside it, and one pass for the class counts (or response sums) on its left.

    Statistics of a group of trees have a bounded size, so wide levels take more passes, not
    more memory. Depth 0 is unlimited.
    """
    drawn = {"sqrt": int(np.sqrt(width)), "log2": int(np.log2(max(width, 2)))}.get(max_features, width) or 1
    if label is not None:
        named = df.select("x", F.col(label).cast("string").alias("_l"))
        classes = tuple(r["_l"] for r in named.select("_l").distinct().orderBy("_l").collect())
        code = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("_l")).cast("int") - 1
        data = named.select("x", code.alias("t")).persist()
        q = len(classes)
        target = lambda c: (c["t"].astype(int)[:, None] == np.arange(q)).astype(float)
    else:
        classes = None
        data = df.select("x", F.col("y").alias("t")).persist()
        q = data.select(F.size("t").alias("q")).first()["q"]
        target = lambda c: np.hstack([np.ones((len(c["x"]), 1)), c["t"], c["t"] ** 2])
    sums = q if classes else 1 + 2 * q
    try:
        few = few_tasks(data)
        whole = sum_blocks(data, ["x", "t"], lambda c: target(c).sum(axis=0), few)
        grown = [{"feature": np.array([-1]), "threshold": np.zeros(1), "left": np.array([-1]),
                  "stats": whole[None, :].copy()} for _ in range(max(10, trees))]
        front = [np.array([0]) for _ in grown]   # nodes that may still split
        for level in range(depth) if depth > 0 else count():
            splittable = [_worth(t["stats"][f], classes, min_leaf) for t, f in zip(grown, front)]
            front = [f[s] for f, s in zip(front, splittable)]
            if not any(len(f) for f in front):
                break
            for group in _groups(front, drawn * sums):
                _split(data, grown, front, group, width, drawn, target, sums, classes, min_leaf, criterion,
                       seed + 7919 * level, few)
        done = []
        for t in grown:
            value = t["stats"] / np.maximum(t["stats"].sum(1, keepdims=True), 1e-300) if classes else \
                t["stats"][:, 1:1 + q] / np.maximum(t["stats"][:, :1], 1e-300)
            done.append({"feature": t["feature"], "threshold": t["threshold"], "left": t["left"], "value": value})
        return ExtraTrees(done, classes)
    finally:
        data.unpersist()


def _size(stats, classes):
    return stats.sum(axis=-1) if classes else stats[..., 0]


def _impurity(stats, classes, criterion):
    """Total (not mean) impurity of nodes."""
    n = np.maximum(_size(stats, classes), 1e-300)
    if classes:
        share = stats / n[..., None]
        if criterion == "gini":
            return n * (1 - (share ** 2).sum(-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return -n * np.where(share > 0, share * np.log(share), 0).sum(-1)
    q = (stats.shape[-1] - 1) // 2
    return (stats[..., 1 + q:] - stats[..., 1:1 + q] ** 2 / n[..., None]).sum(-1)


def _worth(stats, classes, min_leaf):
    return (_size(stats, classes) >= max(2, 2 * min_leaf)) & (_impurity(stats, classes, "gini") > 1e-9)


def _groups(front, cells_per_node):
    group, held = [], 0
    for i, nodes in enumerate(front):
        cost = len(nodes) * cells_per_node
        if group and held + cost > _HELD_CELLS:
            yield group
            group, held = [], 0
        if cost:
            group.append(i)
            held += cost
    if group:
        yield group


def _split(data, grown, front, group, width, drawn, target, sums, classes, min_leaf, criterion, seed, few):
    rng = np.random.default_rng(seed)
    picks = {i: np.stack([rng.choice(width, drawn, replace=False) for _ in front[i]]) for i in group}
    shapes = {i: {k: grown[i][k] for k in ("feature", "threshold", "left")} for i in group}
    slots = {i: _slot(front[i], len(grown[i]["feature"])) for i in group}

    def ranges(c):
        out = []
        for i in group:
            at = slots[i][_descend(shapes[i], c["x"])]
            rows = np.flatnonzero(at >= 0)
            values = np.take_along_axis(c["x"][rows], picks[i][at[rows]], axis=1)
            low = np.full((len(picks[i]), drawn), np.inf)
            high = low.copy()
            np.minimum.at(low, at[rows], values)
            np.minimum.at(high, at[rows], -values)
            out += [low.ravel(), high.ravel()]
        return np.concatenate(out)

    found = sum_blocks(data, ["x"], ranges, few, lowest=True)
    cuts, place = {}, 0
    for i in group:
        size = picks[i].size
        low = found[place:place + size].reshape(-1, drawn)
        high = -found[place + size:place + 2 * size].reshape(-1, drawn)
        place += 2 * size
        cuts[i] = np.where(high > low, low + (high - low) * rng.uniform(size=low.shape), np.nan)

    def counts(c):
        out = []
        y = target(c)
        for i in group:
            at = slots[i][_descend(shapes[i], c["x"])]
            rows = np.flatnonzero(at >= 0)
            left = np.take_along_axis(c["x"][rows], picks[i][at[rows]], axis=1) <= cuts[i][at[rows]]
            held = np.zeros((len(picks[i]), drawn, sums))
            for j in range(drawn):
                np.add.at(held[:, j], at[rows], y[rows] * left[:, j:j + 1])
            out.append(held.ravel())
        return np.concatenate(out)

    found = sum_blocks(data, ["x", "t"], counts, few)
    place = 0
    for i in group:
        size = picks[i].size * sums
        left = found[place:place + size].reshape(-1, drawn, sums)
        place += size
        t, nodes = grown[i], front[i]
        parent = t["stats"][nodes][:, None, :]
        right = parent - left
        gain = _impurity(parent, classes, criterion) - _impurity(left, classes, criterion) - \
            _impurity(right, classes, criterion)
        legal = (_size(left, classes) >= min_leaf) & (_size(right, classes) >= min_leaf) & np.isfinite(cuts[i])
        gain = np.where(legal, gain, -np.inf)
        best = gain.argmax(axis=1)
        rows = np.flatnonzero(np.isfinite(gain[np.arange(len(nodes)), best]))
        first = len(t["feature"]) + 2 * np.arange(len(rows))
        t["feature"][nodes[rows]] = picks[i][rows, best[rows]]
        t["threshold"][nodes[rows]] = cuts[i][rows, best[rows]]
        t["left"][nodes[rows]] = first
        fresh = np.stack([left[rows, best[rows]], right[rows, best[rows]]], axis=1).reshape(-1, sums)
        t["feature"] = np.concatenate([t["feature"], np.full(2 * len(rows), -1)])
        t["threshold"] = np.concatenate([t["threshold"], np.zeros(2 * len(rows))])
        t["left"] = np.concatenate([t["left"], np.full(2 * len(rows), -1)])
        t["stats"] = np.concatenate([t["stats"], fresh])
        front[i] = np.arange(len(t["feature"]) - 2 * len(rows), len(t["feature"]))


def _slot(nodes: np.ndarray, total: int) -> np.ndarray:
    out = np.full(total, -1)
    out[nodes] = np.arange(len(nodes))
    return out


# --- AdaBoost -----------------------------------------------------------------------------

@dataclass(frozen=True)
class BoostedClassifier:
    models: list
    weights: list[float]
    classes: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        out = _votes(_vectors(df), self.models, self.weights, len(self.classes))
        names = F.array(*[F.lit(k) for k in self.classes])
        best = F.array_position("_votes", F.array_max("_votes")).cast("int") - 1
        total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("pred", F.get(names, best))
                .withColumn("proba", F.transform("_votes", lambda v: v / total)).drop("_v", "x", "_votes"))


def _votes(df, models, weights, k):
    drop = ["rawPrediction", "probability", "prediction"]
    out = df.withColumn("_votes", F.array_repeat(F.lit(0.0), k))
    for m, w in zip(models, weights):
        out = m.transform(out).withColumn(
            "_votes", F.transform("_votes", lambda v, i: v + F.when(F.col("prediction") == i, w).otherwise(0.0))).drop(*drop)
    return out


def adaboost_classifier(df: DataFrame, label: str, rounds: int = 50, depth: int = 1, seed: int = 42) -> BoostedClassifier:
    """SAMME; the row weights are written out every few rounds, so the lineage stays short."""
    named = df.select("x", F.col(label).cast("string").alias("_label"))
    index = StringIndexer(inputCol="_label", outputCol="_code", stringOrderType="alphabetAsc").fit(named)
    state = _vectors(index.transform(named)).select("_v", "_code", F.lit(1.0).alias("_w"))
    k, models, alphas = len(index.labels), [], []
    wrong = F.col("prediction") != F.col("_code")
    for i in range(rounds):
        if i % _KEEP_EVERY == 0:
            state = durable(state)
        model = DecisionTreeClassifier(featuresCol="_v", labelCol="_code", weightCol="_w", maxDepth=depth,
                                       seed=seed + i).fit(state)
        judged = model.transform(state).select("_v", "_code", "_w", "prediction")
        e = judged.agg((F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("e")).first()["e"]
        if e <= 0 or e >= 1 - 1 / k:
            if e <= 0 or not models:
                models, alphas = models + [model], alphas + [1.0]
            break
        models.append(model)
        alphas.append(float(np.log((1 - e) / e) + np.log(k - 1)))
        state = judged.select("_v", "_code", (F.col("_w") * F.when(wrong, float(np.exp(alphas[-1]))).otherwise(1.0)).alias("_w"))
    return BoostedClassifier(models, alphas, tuple(index.labels))


@dataclass(frozen=True)
class BoostedRegressor:
    models: list
    weights: list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        """Weighted median of the members."""
        out = _vectors(df)
        for i, m in enumerate(self.models):
            out = m.setPredictionCol(f"_p{i}").transform(out)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(w).alias("w"))
                                       for i, w in enumerate(self.weights)]))
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
        pick = F.aggregate(pairs, start, lambda a, x: F.struct(
            (a["s"] + x["w"]).alias("s"), F.coalesce(a["v"], F.when(a["s"] + x["w"] >= half, x["p"])).alias("v")),
            lambda a: a["v"])
        return out.withColumn("yhat", F.array(pick)).drop("_v", "x", *[f"_p{i}" for i in range(len(self.models))])


def adaboost_regressor(df: DataFrame, rounds: int = 50, depth: int = 3, seed: int = 42) -> BoostedRegressor:
    """AdaBoost.R2 with linear loss on the first response."""
    state = _vectors(df.select("x", F.get("y", F.lit(0)).alias("label"))).select("_v", "label", F.lit(1.0).alias("_w"))
    models, betas = [], []
    for i in range(rounds):
        if i % _KEEP_EVERY == 0:
            state = durable(state)
        model = DecisionTreeRegressor(featuresCol="_v", labelCol="label", weightCol="_w", maxDepth=depth,
                                      seed=seed + i).fit(state)
        gaps = model.transform(state).select("_v", "label", "_w", F.abs(F.col("prediction") - F.col("label")).alias("_e"))
        facts = gaps.agg(F.max("_e").alias("top"), (F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("mean")).first()
        mean = facts["mean"] / facts["top"] if facts["top"] > 0 else 0.0
        if mean <= 0 or mean >= 0.5:
            if mean <= 0 or not models:
                models, betas = models + [model], betas + [np.exp(-1.0)]
            break
        models.append(model)
        betas.append(float(mean / (1 - mean)))
        weight = F.col("_w") * F.pow(F.lit(betas[-1]), 1 - F.col("_e") / float(facts["top"]))
        state = gaps.select("_v", "label", weight.alias("_w"))
    return BoostedRegressor(models, [float(np.log(1 / b)) for b in betas])
