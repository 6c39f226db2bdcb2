"""Discriminant classifiers from per-class moments: LDA, QDA, PLS-DA, nearest centroid rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrays import block, map_blocks
from ..dataset import Dataset
from .folds import CV, assign, test_rows, training_rows
from .linear import LinearFit, pls, pls_coefficients
from .moments import Moments, moments, total


@dataclass(frozen=True)
class ClassRule:
    """A row-local decision: class names and a function block → probabilities."""

    kind: str
    classes: tuple[str, ...]
    linear: tuple[np.ndarray, np.ndarray] | None = None
    quadratic: tuple | None = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "pls_da":
            raw = np.clip(x @ self.linear[0] + self.linear[1], 0, None)
            size = raw.sum(axis=1, keepdims=True)
            return raw / np.where(size > 0, size, 1)
        if self.quadratic is not None:
            means, rotations, scales, priors = self.quadratic
            d = np.empty((len(x), len(means)))
            for k in range(len(means)):
                z = ((x - means[k]) @ rotations[k]) / np.sqrt(scales[k])
                d[:, k] = -0.5 * ((z * z).sum(1) + np.log(scales[k]).sum()) + np.log(priors[k])
        else:
            d = x @ self.linear[0] + self.linear[1]
        d = np.exp(d - d.max(axis=1, keepdims=True))
        return d / d.sum(axis=1, keepdims=True)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``pred`` and ``proba`` (in the order of ``classes``; ties go to the first)."""
        names = np.array(self.classes)

        def run(c):
            p = self.probabilities(c["x"])
            return {"pred": pa.array(names[p.argmax(1)].tolist(), pa.string()), "proba": p}

        return map_blocks(df, run, [("pred", "string"), ("proba", "array<double>")], ["x"],
                          [c for c in df.columns if c not in ("x", "pred", "proba")])


def _pooled(parts: dict[str, Moments]) -> np.ndarray:
    return sum(m.xx for m in parts.values())


def lda(parts: dict[str, Moments], solver: str = "svd", shrinkage: dict[str, float] | None = None) -> ClassRule:
    """Linear discriminant; ``shrinkage`` gives a Ledoit–Wolf weight per class (lsqr and eigen)."""
    names = sorted(parts)
    n = sum(parts[k].n for k in names)
    priors = np.array([parts[k].n / n for k in names])
    means = np.stack([parts[k].x_mean for k in names])
    if solver == "svd":
        cov = _pooled(parts) / max(n - len(names), 1)
    elif shrinkage is None:
        cov = _pooled(parts) / n
    else:
        cov = sum(pr * _shrunk(parts[k], shrinkage[k]) for k, pr in zip(names, priors))
    coef = np.linalg.pinv(cov, hermitian=True) @ means.T
    return ClassRule("lda", tuple(names), (coef, -0.5 * (means.T * coef).sum(0) + np.log(priors)))


def _shrunk(m: Moments, weight: float) -> np.ndarray:
    """Covariance of standardised variables pulled to its mean variance, scaled back."""
    cov = m.xx / m.n
    s = np.sqrt(np.diag(cov))
    s = np.where(s > 0, s, 1.0)
    corr = cov / np.outer(s, s)
    target = np.trace(corr) / len(s) * np.eye(len(s))
    return ((1 - weight) * corr + weight * target) * np.outer(s, s)


def ledoit_wolf_weights(df: DataFrame, parts: dict[str, Moments], label: str) -> dict[str, float]:
    """Shrinkage weight per class from one further scan (sum of fourth powers of norms)."""
    fit = {k: (m.x_mean, np.where(m.std() > 0, m.std(), 1.0)) for k, m in parts.items()}

    def run(batches):
        held: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, names = block(batch.column("x")), np.array(batch.column("k").to_pylist())
            for k in np.unique(names):
                z = (x[names == k] - fit[k][0]) / fit[k][1]
                held[k] = held.get(k, 0.0) + float(((z * z).sum(1) ** 2).sum())
        if held:
            yield pa.RecordBatch.from_pydict({"k": list(held), "v": list(held.values())})

    rows = (df.select(F.col(label).cast("string").alias("k"), "x").mapInArrow(run, "k string, v double")
            .groupBy("k").agg(F.sum("v").alias("v")).collect())
    out = {}
    for r in rows:
        m = parts[r["k"]]
        p = m.p
        s = np.where(m.std() > 0, m.std(), 1.0)
        cov = m.xx / m.n / np.outer(s, s)
        mu = np.trace(cov) / p
        squares = (cov * cov).sum()
        delta = (squares - 2 * mu * np.trace(cov) + p * mu * mu) / p
        beta = min((r["v"] / m.n - squares) / (p * m.n), delta)
        out[r["k"]] = 0.0 if beta <= 0 or delta <= 0 else beta / delta
    return out


def qda(parts: dict[str, Moments], reg: float = 0.0) -> ClassRule:
    if not 0 <= reg <= 1:
        raise ValueError("reg must lie in 0..1")
    names = sorted(parts)
    n = sum(parts[k].n for k in names)
    rotations, scales = [], []
    for k in names:
        values, vectors = np.linalg.eigh(parts[k].covariance(1))
        rotations.append(vectors)
        scales.append(np.maximum((1 - reg) * np.maximum(values, 0) + reg, 1e-12))
    return ClassRule("qda", tuple(names), None, (
        [parts[k].x_mean for k in names], rotations, scales, [parts[k].n / n for k in names]))


def onehot_moments(parts: dict[str, Moments]) -> tuple[list[str], Moments]:
    """Moments of (x, one-hot class) from per-class moments: no second scan for PLS-DA."""
    names = sorted(parts)
    q = len(names)
    extended = []
    for j, k in enumerate(names):
        m = parts[k]
        e = np.eye(q)[j]
        m2 = np.zeros((m.p + q,) * 2)
        m2[:m.p, :m.p] = m.xx
        extended.append(Moments(m.n, np.concatenate([m.x_mean, e]), m2, m.p))
    return names, total(extended)


def pls_da(parts: dict[str, Moments], components: int, scale: bool = False) -> ClassRule:
    names, m = onehot_moments(parts)
    fit: LinearFit = pls_coefficients(pls(m, components, scale), m, components)
    return ClassRule("pls_da", tuple(names), (fit.coef, fit.intercept))


def fit_rule(kind: str, parts: dict[str, Moments], **hp) -> ClassRule:
    if kind == "lda":
        return lda(parts, hp.get("solver", "svd"), hp.get("shrinkage"))
    if kind == "qda":
        return qda(parts, hp.get("reg", 0.0))
    if kind == "pls_da":
        return pls_da(parts, hp.get("components", 2), hp.get("scale", False))
    raise ValueError(f"unknown discriminant {kind}")


def class_moments(df: DataFrame, label: str, width: int) -> dict[str, Moments]:
    return moments(df, "x", key=F.col(label).cast("string"), width=width)


def discriminant(ds: Dataset, label: str, kind: str = "lda", **hp) -> ClassRule:
    parts = class_moments(ds.cal, label, ds.width)
    if kind == "lda" and hp.get("shrinkage") == "auto":
        hp["shrinkage"] = None if hp.get("solver", "svd") == "svd" else \
            ledoit_wolf_weights(ds.cal, parts, label)
    return fit_rule(kind, parts, **hp)


def discriminant_cv(ds: Dataset, label: str, kind: str, cv: CV, n: int | None = None, **hp) -> DataFrame:
    """Out-of-fold (ix, fold, label, pred, proba); fold probabilities follow all class names.

    Moments per (fold, class) in one scan; a class absent from a training set gets 0.
    """
    df = ds.cal.withColumn("_label", F.col(label).cast("string"))
    if "classes" not in df.columns:
        df = df.withColumn("classes", F.array("_label"))
    assigned = assign(df.select("ix", "x", "_label", "classes"), cv, n)
    if cv.strategy == "loocv":
        parts = class_moments(assigned, "_label", ds.width)
        names = sorted(parts)

        def own(c):
            out = []
            for x, k in zip(c["x"], c["_label"]):
                less = dict(parts)
                less[k] = parts[k] - Moments(1.0, x, np.zeros_like(parts[k].m2), parts[k].p)
                rule = fit_rule(kind, {a: m for a, m in less.items() if m.n > 0}, **hp)
                out.append(_aligned(rule, rule.probabilities(x[None, :]), names)[0])
            p = np.array(out)
            return {"pred": pa.array(np.array(names)[p.argmax(1)].tolist()), "proba": p}

        return map_blocks(assigned, own, [("pred", "string"), ("proba", "array<double>")], ["x", "_label"],
                          ["ix", "fold", "_label"]).withColumnRenamed("_label", label)
    both = F.concat_ws("\u0001", F.col("fold").cast("string"), "_label")
    source = assigned if cv.partitions else training_rows(assigned)
    parts = moments(source, "x", key=both, weight=None if cv.partitions else "weight", width=ds.width)
    by_fold: dict[int, dict[str, Moments]] = {}
    for key, m in parts.items():
        fold, name = key.split("\u0001")
        by_fold.setdefault(int(fold), {})[name] = m
    names = sorted({k for part in by_fold.values() for k in part})
    if cv.partitions:
        whole = {k: total([p[k] for p in by_fold.values() if k in p]) for k in names}
        by_fold = {f: {k: (whole[k] - part[k] if k in part else whole[k]) for k in names}
                   for f, part in by_fold.items()}
    rules = {f: fit_rule(kind, {k: m for k, m in part.items() if m.n > 0}, **hp) for f, part in by_fold.items()}
    rows = assigned if cv.partitions else test_rows(assigned)

    def run(c):
        folds = c["fold"].astype(int)
        p = np.zeros((len(folds), len(names)))
        for f in np.unique(folds):
            at = folds == f
            p[at] = _aligned(rules[f], rules[f].probabilities(c["x"][at]), names)
        return {"pred": pa.array(np.array(names)[p.argmax(1)].tolist()), "proba": p}

    return map_blocks(rows, run, [("pred", "string"), ("proba", "array<double>")], ["x", "fold"],
                      ["ix", "fold", "_label"]).withColumnRenamed("_label", label)


def _aligned(rule: ClassRule, p: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.zeros((len(p), len(names)))
    out[:, [names.index(k) for k in rule.classes]] = p
    size = out.sum(1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def result_table(pred: DataFrame, label: str, classes: tuple[str, ...], sample: str = "ix") -> DataFrame:
    """sample, predicted, reference, one probability column per class, error flag."""
    return pred.select(sample, F.col("pred").alias("predicted"), F.col(label).cast("string").alias("reference"),
                       *[F.get("proba", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(classes)],
                       (F.col("pred") != F.col(label).cast("string")).alias("error"))


@dataclass(frozen=True)
class CentroidRule:
    """Nearest class mean (Euclidean; ties to the first class), probabilities from softmax(-d)."""

    classes: tuple[str, ...]
    means: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        names = np.array(self.classes)

        def run(c):
            d = np.sqrt(((c["x"][:, None, :] - self.means[None]) ** 2).sum(2))
            p = np.exp(d.min(axis=1, keepdims=True) - d)
            return {"pred": pa.array(names[d.argmin(1)].tolist()), "distance": d.min(1),
                    "proba": p / p.sum(axis=1, keepdims=True)}

        return map_blocks(df, run, [("pred", "string"), ("distance", "double"), ("proba", "array<double>")], ["x"],
                          [c for c in df.columns if c not in ("x", "pred", "distance", "proba")])


def centroid_rule(df: DataFrame, label: str, width: int) -> CentroidRule:
    parts = class_moments(df, label, width)
    names = tuple(sorted(parts))
    return CentroidRule(names, np.stack([parts[k].x_mean for k in names]))


def nearest_centroid(df: DataFrame, label: str, width: int) -> DataFrame:
    return centroid_rule(df, label, width).predict(df)
