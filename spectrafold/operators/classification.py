"""One front end for the n-class methods, with cross-validated labels and probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from . import discriminant, kernels, neighbors, trees
from .folds import CV, assign, test_rows, training_rows

METHODS = ("logistic", "random_forest", "extra_trees", "svc", "knn", "lda", "qda", "pls_da")
_MOMENT = ("lda", "qda", "pls_da")


@dataclass(frozen=True)
class NeighborClassifier:
    train: DataFrame
    label: str
    width: int
    classes: tuple[str, ...]
    hp: dict

    def predict(self, df: DataFrame) -> DataFrame:
        found = neighbors.knn_classify(df, self.train, self.label, width=self.width, **self.hp)
        given = F.map_from_arrays(F.transform("proba", lambda p: p["label"]), F.transform("proba", lambda p: p["p"]))
        aligned = F.transform(F.array(*[F.lit(k) for k in self.classes]),
                              lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0)))
        found = found.withColumn("_m", given).withColumn("proba", aligned).drop("_m")
        return df.drop("x", "pred", "proba").join(found, "ix")


class Classifier:
    """``fit(ds, label)`` gives a model whose ``predict`` adds ``pred`` and ``proba``."""

    def __init__(self, method: str, **hp):
        if method not in METHODS:
            raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
        self.method, self.hp = method, hp

    def _fit(self, cal: DataFrame, label: str, width: int):
        hp = dict(self.hp)
        if self.method in ("logistic", "random_forest"):
            return trees.ml_classifier(cal, label, self.method, **hp)
        if self.method == "extra_trees":
            return trees.extra_trees(cal, width, label, **hp)
        if self.method == "svc":
            kind = hp.pop("kernel", "rbf")
            f = kernels.features(kind, width, hp.pop("gamma", 1.0 / width), hp.pop("size", 256), hp.pop("degree", 3),
                                 hp.pop("coef0", 0.0))
            return kernels.svc(cal, label, f, **hp)
        names = cal.select(F.col(label).cast("string").alias("k")).distinct().orderBy("k")
        return NeighborClassifier(cal, label, width, tuple(r["k"] for r in names.collect()), hp)

    def fit(self, ds: Dataset, label: str):
        if self.method in _MOMENT:
            return discriminant.discriminant(ds, label, self.method, **self.hp)
        return self._fit(ds.cal, label, ds.width)

    def cross_validate(self, ds: Dataset, label: str, cv: CV, n: int | None = None) -> DataFrame:
        """Out-of-fold (ix, fold, label, pred, proba); rows no fold tests are absent."""
        if self.method in _MOMENT:
            return discriminant.discriminant_cv(ds, label, self.method, cv, n, **self.hp)
        df = ds.cal
        if "classes" not in df.columns:
            df = df.withColumn("classes", F.array(F.col(label).cast("string")))
        assigned = assign(df.select("ix", "x", label, "classes"), cv, n)
        if self.method == "knn" and cv.partitions:
            # one join that leaves each row's own fold out serves all folds
            names = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect())
            rows = assigned.select("ix", "x", label, "fold")
            return NeighborClassifier(rows, label, ds.width, tuple(names), {**self.hp, "exclude": "fold"}).predict(rows)
        if cv.strategy == "loocv":
            raise ValueError("leave-one-out refits per row: choose folds for this method")
        train, test = training_rows(assigned), test_rows(assigned)
        out = None
        for f in range(cv.k * (cv.repeats if cv.strategy == "repeated_kfold" else 1)):
            rows = train.filter(F.col("fold") == f)
            if "train_weights" in assigned.columns:
                rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_t")
            model = self._fit(rows.select("ix", "x", label), label, ds.width)
            held = model.predict(test.filter(F.col("fold") == f).select("ix", "x", label, "fold"))
            held = held.select("ix", "fold", label, "pred", align(model.classes).alias("proba"))
            out = held if out is None else out.unionByName(held)
        every = sorted({r[0] for r in df.select(F.col(label).cast("string")).distinct().collect()})
        return out.withColumn("proba", F.transform(F.array(*[F.lit(k) for k in every]),
                                                   lambda k: F.coalesce(F.element_at("proba", k), F.lit(0.0))))


def align(classes: tuple[str, ...]):
    """Probabilities as a map by class, so that models of different classes line up."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in classes]), F.col("proba"))
