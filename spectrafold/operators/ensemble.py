"""Ensembles, stacking, sweeps, loops and branches over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..session import durable
from . import trees
from .calibration import Calibration
from .classification import Classifier

_STEPS: dict[str, Callable[[Dataset], Dataset]] = {}


def checked_weights(weights, count: int) -> list[float]:
    """Weights must match the members, be non-negative and not all zero."""
    if weights is None:
        return [1.0] * count
    weights = [float(w) for w in weights]
    if len(weights) != count:
        raise ValueError(f"{count} members need {count} weights, got {len(weights)}")
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative and not all zero")
    return weights


def stacked(members: list[DataFrame], weights=None) -> DataFrame:
    """Union of the members with ``member`` (its place) and ``w``."""
    weights = checked_weights(weights, len(members))
    out = None
    for i, (m, w) in enumerate(zip(members, weights)):
        part = m.withColumn("member", F.lit(i)).withColumn("w", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out


def check_alignment(union: DataFrame, members: int, keys: list[str]) -> None:
    """Every id once in every member; anything else is an error."""
    per = union.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("member").alias("m"))
    worst = per.agg(F.max(F.col("n") - F.col("m")).alias("twice"), F.min("m").alias("least")).first()
    if worst["twice"]:
        raise ValueError("a member holds an id more than once")
    if worst["least"] != members:
        raise ValueError("a member lacks an id that another has")


def combine_regression(members: list[DataFrame], how: str = "mean", weights=None, check: bool = True) -> DataFrame:
    """(ix, response, yhat) by mean, median or weighted_mean of members (ix, response, yhat)."""
    union = stacked([m.select("ix", "response", "yhat") for m in members], weights)
    if check:
        check_alignment(union, len(members), ["ix", "response"])
    agg = {"mean": F.avg("yhat"), "median": F.median("yhat"),
           "weighted_mean": F.sum(F.col("w") * F.col("yhat")) / F.sum("w")}
    if how not in agg:
        raise ValueError(f"unknown rule {how}")
    return union.groupBy("ix", "response").agg(agg[how].alias("yhat"))


def hard_vote(members: list[DataFrame], weights=None, check: bool = True) -> DataFrame:
    """(ix, pred, votes): most (weighted) votes; a tie goes to the label an earlier member gave."""
    union = stacked([m.select("ix", "pred") for m in members], weights)
    if check:
        check_alignment(union, len(members), ["ix"])
    votes = union.groupBy("ix", "pred").agg(F.sum("w").alias("votes"), F.min("member").alias("first"))
    return votes.groupBy("ix").agg(F.max_by("pred", F.struct("votes", -F.col("first"))).alias("pred"),
                                   F.max("votes").alias("votes"))


def soft_vote(members: list[DataFrame], weights=None, check: bool = True) -> DataFrame:
    """(ix, pred, p, tied) from member rows (ix, label, p).

    Labels a member does not know count 0 and each member is renormalised; ties go to the first
    label. A member without a ``p`` column turns the whole vote into a hard vote on ``pred``.
    """
    if any("p" not in m.columns for m in members):
        hard = [m if "pred" in m.columns else m.groupBy("ix").agg(F.max_by("label", "p").alias("pred")) for m in members]
        return hard_vote(hard, weights, check)
    union = stacked([m.select("ix", "label", "p") for m in members], weights)
    if check:
        check_alignment(union.select("ix", "member").distinct(), len(members), ["ix"])
    size = union.groupBy("ix", "member").agg(F.sum("p").alias("_s"))
    union = union.join(size, ["ix", "member"]).withColumn("p", F.when(F.col("_s") > 0, F.col("p") / F.col("_s")).otherwise(0.0))
    total = sum(checked_weights(weights, len(members)))
    sums = union.groupBy("ix", "label").agg((F.sum(F.col("w") * F.col("p")) / total).alias("p"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "label")))
    out = sums.groupBy("ix").agg(ranked.alias("_r"))
    return out.select("ix", F.get("_r", F.lit(0))["label"].alias("pred"), (-F.get("_r", F.lit(0))["n"]).alias("p"),
                      (F.size(F.filter("_r", lambda r: r["n"] == F.get("_r", F.lit(0))["n"])) > 1).alias("tied"))


def long_probabilities(pred: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(ix, label, p) from an array of probabilities in the order of ``classes``."""
    names = F.array(*[F.lit(k) for k in classes])
    return pred.select("ix", F.explode(F.arrays_zip(names.alias("label"), F.col("proba").alias("p"))).alias("s")) \
        .select("ix", "s.label", "s.p")


def tie_count(votes: DataFrame) -> int:
    return votes.agg(F.count_if("tied").alias("n")).first()["n"]


def same_family(kinds: list[str]) -> None:
    """One-class and n-class members cannot be combined."""
    one = {"simca", "dd_simca", "one_class_svm", "isolation_forest", "elliptic_envelope", "lof"}
    if len({k in one for k in kinds}) > 1:
        raise ValueError("one-class and n-class members cannot be combined")


# --- stacking -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Stack:
    meta: object
    width: int

    def predict(self, features: DataFrame) -> DataFrame:
        return self.meta.predict(features)


def stack_features(members: list[DataFrame], base: DataFrame | None = None) -> DataFrame:
    """Join member rows (ix, f ARRAY<DOUBLE>) into ``x``, with the variables of ``base`` if given.

    Every member must hold the same ids, each once; ``base`` may hold others as well.
    """
    check_alignment(stacked([m.select("ix") for m in members]), len(members), ["ix"])
    out = members[0].select("ix", F.col("f").alias("f0"))
    for i, m in enumerate(members[1:], start=1):
        out = out.join(m.select("ix", F.col("f").alias(f"f{i}")), "ix")
    parts = [F.col(f"f{i}") for i in range(len(members))]
    if base is not None:
        out = out.join(base.select("ix", F.col("x").alias("_base")), "ix")
        parts.append(F.col("_base"))
    return out.select("ix", F.concat(*parts).alias("x"))


def one_hot(pred: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return pred.select("ix", F.array(*[(F.col("pred") == k).cast("double") for k in classes]).alias("f"))


def fit_stack(features: DataFrame, target: DataFrame, meta: str = "ridge", task: str = "regression",
              label: str = "label", **hp) -> Stack:
    """Meta-learner on out-of-fold features; ``target`` has (ix, y) or (ix, label)."""
    rows = features.join(target, "ix").persist()
    try:
        if rows.count() != features.count():
            raise ValueError("features and target do not pair one to one")
        width = rows.select(F.size("x").alias("p")).first()["p"]
        if task == "regression":
            ds = Dataset(rows, (width,), scaled=True)
            q = rows.select(F.size("y").alias("q")).first()["q"]
            if meta in ("linear", "ols"):
                model = Calibration("ols").fit(ds)
            elif meta == "ridge":
                model = Calibration("ridge", hp.get("alpha", 1.0)).fit(ds)
            elif meta in ("random_forest", "gradient_boosting", "hist_gradient_boosting", "bagging"):
                model = trees.tree_regressor(rows, meta, q, **hp)
            elif meta == "extra_trees":
                model = trees.extra_trees(rows, width, **hp)
            elif meta == "adaboost":
                model = trees.adaboost_regressor(rows, **hp)
            else:
                raise ValueError(f"unknown meta model {meta}")
        elif meta == "adaboost":
            model = trees.adaboost_classifier(rows, label, **hp)
        elif meta in ("logistic", "random_forest", "extra_trees"):
            model = Classifier(meta, **hp).fit(Dataset(rows, (width,)), label)
        elif meta == "bagging":
            model = trees.ml_classifier(rows, label, "bagging", **hp)
        elif meta in ("gradient_boosting", "hist_gradient_boosting"):
            model = boosted_one_vs_rest(rows, label, width, meta, **hp)
        else:
            raise ValueError(f"unknown meta model {meta}")
        return Stack(model, width)
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class OneVsRestBoosting:
    models: trees.TreeRegressor
    classes: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.models.predict(df)
        names = F.array(*[F.lit(k) for k in self.classes])
        p = F.transform("yhat", lambda v: F.greatest(v, F.lit(0.0)))
        best = F.array_position("yhat", F.array_max("yhat")).cast("int") - 1
        return (out.withColumn("pred", F.get(names, best)).withColumn("_p", p)
                .withColumn("proba", F.transform("_p", lambda v: v / F.greatest(
                    F.aggregate("_p", F.lit(0.0), lambda a, b: a + b), F.lit(1e-12)))).drop("_p", "yhat"))


def boosted_one_vs_rest(rows: DataFrame, label: str, width: int, kind: str, **hp) -> OneVsRestBoosting:
    """Boosted trees on one-hot targets (MLlib's boosting classifier knows two classes only)."""
    names = tuple(r["k"] for r in rows.select(F.col(label).cast("string").alias("k")).distinct().orderBy("k").collect())
    hot = F.array(*[(F.col(label).cast("string") == k).cast("double") for k in names])
    return OneVsRestBoosting(trees.tree_regressor(rows.withColumn("y", hot), kind, len(names), **hp), names)


# --- sweeps, loops, branches, steps -------------------------------------------------------

def sweep(fn: Callable[[object], DataFrame], values, metric: Callable[[DataFrame], float], mode: str = "min"):
    """Run ``fn`` per value; the union of the runs, the score table and the best value.

    Only a strictly better score replaces the best.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode is min or max")
    runs, scores, best = None, [], None
    for v in values:
        df = fn(v)
        part = df.withColumn("sweep_value", F.lit(str(v)))
        runs = part if runs is None else runs.unionByName(part)
        score = float(metric(df))
        scores.append((str(v), score))
        if best is None or (score < best[1] if mode == "min" else score > best[1]):
            best = (v, score)
    table = runs.sparkSession.createDataFrame(scores, "sweep_value string, score double")
    return runs, table, best[0]


def repeat(fn: Callable[[DataFrame], DataFrame], df: DataFrame, times: int, keep_every: int = 5) -> DataFrame:
    """Feed the output back; the state is written out every few passes to cut the lineage."""
    for i in range(times):
        df = fn(df)
        if (i + 1) % keep_every == 0 and i + 1 < times:
            df = durable(df)
    return df


def branches(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "merge") -> DataFrame:
    """Run every branch on the same input; ``merge`` unions with a branch column, ``keep_last`` keeps one."""
    out = None
    for name, fn in steps.items():
        part = fn(df).withColumn("branch", F.lit(name))
        out = part if out is None or mode == "keep_last" else out.unionByName(part)
    return out


def register_step(name: str, fn: Callable[[Dataset], Dataset]) -> None:
    """Make a user function available by name."""
    if not callable(fn):
        raise TypeError("a step is a function of a dataset")
    _STEPS[name] = fn


def run_step(name: str, ds: Dataset) -> Dataset:
    if name not in _STEPS:
        raise KeyError(f"no step named {name}")
    return _STEPS[name](ds)


def pass_forward(scored: DataFrame, ds: Dataset, column: str = "scores", prefix: str = "PC") -> Dataset:
    """Model scores become the variables of the next step, with their own axis labels."""
    from ..dataset import Axis
    k = scored.select(F.size(column).alias("k")).first()["k"]
    keep = [c for c in scored.columns if c not in ("x", column)]
    df = scored.select(*keep, F.col(column).alias("x"))
    return ds.with_df(df, shape=(k,), axes=(Axis(texts=tuple(f"{prefix}{i + 1}" for i in range(k)), nature="Discrete"),),
                      scaled=False)
