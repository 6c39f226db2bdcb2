"""One front end for the calibration models: fit, predict, tune over a grid.

Linear and latent models take all candidates of all folds from one scan of moments. Local models
search neighbours; trees, support vectors and the Gaussian process fit once per candidate and
fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.specs import number_list
from ..session import durable
from . import kernels, linear, neighbors, trees
from .folds import CV, assign, test_rows, training_rows
from .linear import LinearFit, curve, long_predictions
from .moments import moments
from .ordering import with_index
from .preprocess import ScaleModel, fit_scale

KINDS = ("ols", "ridge", "lasso", "elastic_net", "random_forest", "svr", "gradient_boosting",
         "hist_gradient_boosting", "gaussian_process", "pls", "pcr", "kernel_pls", "local")
# kinds that assume scaled variables and autoscale data that was not
_WANTS_SCALE = ("ridge", "lasso", "elastic_net", "svr", "gaussian_process", "kernel_pls")
_LATENT = ("pls", "pcr", "kernel_pls")
# default grids per kind (fixed values)
_PENALTIES = [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]
_COSTS = [0.1, 1.0, 10.0, 100.0]
_NOISES = [1e-8, 1e-6, 1e-4, 1e-2, 1e-1]
_LOCAL = [0.25, 0.5, 1.0, 2.0, 3.0, 5.0]


def candidates(kind: str, spec, n: int, width: int, method: str = "knn") -> list[float]:
    """Sorted distinct candidates; one number of components or neighbours N means 1..N."""
    values = number_list(spec)
    whole = kind in _LATENT + ("random_forest", "gradient_boosting", "hist_gradient_boosting") or \
        (kind == "local" and method == "knn")
    if whole:
        found = [int(round(v)) for v in values if v >= 1]
        if len(found) == 1 and kind in _LATENT + ("local",):
            found = list(range(1, found[0] + 1))
        top = {"random_forest": 300, "gradient_boosting": 400, "hist_gradient_boosting": 400,
               "local": max(1, min(n - 1, 25))}.get(kind, min(max(1, min(width, n - 1)), 15))
        return sorted(set(found)) or list(range(1, top + 1))
    default = {"svr": _COSTS, "gaussian_process": _NOISES, "local": _LOCAL}.get(kind, _PENALTIES)
    return sorted({float(v) for v in values if v > 0}) or list(default)


@dataclass(frozen=True)
class Fitted:
    kind: str
    value: float
    model: object
    scale: ScaleModel | None = None
    feature: kernels.Features | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``yhat`` (and ``sd`` for the Gaussian process)."""
        if self.scale is not None:
            df = self.scale.transform(df)
        if self.feature is not None:
            df = kernels.map_features(df, self.feature)
        return self.model.predict(df)


@dataclass(frozen=True)
class LocalModel:
    train: DataFrame
    width: int
    responses: int
    hp: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        found = neighbors.local_predict(df, self.train, width=self.width, responses=self.responses, **self.hp)
        return df.drop("x").join(found, "ix")


@dataclass(frozen=True)
class Tuned:
    best: float
    curve: DataFrame             # candidate, rmse and r2 of cross-validation
    predictions: DataFrame       # ix, fold, candidate, response, y, yhat
    self_curve: DataFrame
    val_curve: DataFrame | None
    model: Fitted


class Calibration:
    """``value`` is the tunable parameter: components, penalty, trees, C, noise or neighbours."""

    def __init__(self, kind: str, value: float | None = None, **hp):
        if kind not in KINDS:
            raise ValueError(f"unknown model {kind}; one of {', '.join(KINDS)}")
        self.kind, self.value, self.hp = kind, value, hp

    # -- preparation

    def _prepared(self, ds: Dataset) -> tuple[Dataset, ScaleModel | None, kernels.Features | None]:
        scale = feature = None
        if self.kind in _WANTS_SCALE and not ds.scaled:
            scale = fit_scale(ds.cal, "autoscale")
            ds = ds.with_df(scale.transform(ds.df), scaled=True)
        if self.kind == "kernel_pls":
            feature = kernels.features("rbf", ds.width, self.hp.get("gamma", 1.0 / ds.width),
                                       max(10, self.hp.get("size", 100)), seed=self.hp.get("seed", 42))
            ds = ds.with_df(kernels.map_features(ds.df, feature), shape=(feature.weights.shape[1],), axes=())
        return ds, scale, feature

    def _linear_kind(self) -> str:
        return "pls" if self.kind == "kernel_pls" else self.kind

    def _linear_hp(self) -> dict:
        return {k: v for k, v in self.hp.items() if k in ("l1_ratio", "scale", "max_iter")}

    def _fit_other(self, cal: DataFrame, value, width: int, responses: int):
        hp = self.hp
        if self.kind in ("random_forest", "gradient_boosting", "hist_gradient_boosting"):
            return trees.tree_regressor(cal, self.kind, responses, int(value or 100), **hp)
        if self.kind == "svr":
            gamma = hp.get("gamma", 0.0)
            gamma = gamma if gamma > 0 else kernels.scale_gamma(cal, width)
            f = kernels.features(hp.get("kernel", "rbf"), width, gamma, hp.get("size", 256), max(1, hp.get("degree", 3)),
                                 hp.get("coef0", 0.0))
            return kernels.svr(cal, f, max(1e-12, float(value or 1.0)), max(1e-12, hp.get("epsilon", 0.1)))
        if self.kind == "gaussian_process":
            length = max(1e-8, hp.get("length_scale", 1.0))
            f = kernels.features("rbf", width, 1 / (2 * length ** 2), hp.get("size", 256))
            return kernels.gaussian_process(cal, f, max(1e-12, float(value or 1e-2)), max(1e-8, hp.get("constant", 1.0)),
                                            hp.get("normalize_y", False))
        return LocalModel(cal.select("ix", "x", "y"), width, responses, self._local_hp(value))

    def _local_hp(self, value) -> dict:
        hp = {"method": "knn", **self.hp}
        name = {"knn": "k", "idw": "power", "adaptive": "alpha", "radius": "radius", "kernel": "bandwidth"}[hp["method"]]
        if value is not None:
            hp[name] = int(value) if name == "k" else float(value)
        return hp

    # -- public

    def fit(self, ds: Dataset) -> Fitted:
        ds, scale, feature = self._prepared(ds)
        if self.kind in linear.PATH_KINDS + ("kernel_pls",):
            m = moments(ds.cal, "x", "y", width=ds.width)[""]
            value = self.value if self.value is not None else {"pls": 2, "pcr": 2, "kernel_pls": 2}.get(self.kind, 1.0)
            (model,) = linear.path(self._linear_kind(), m, [value], **self._linear_hp())
        else:
            value = self.value
            model = self._fit_other(ds.cal, value, ds.width, linear.response_count(ds))
        return Fitted(self.kind, value, model, scale, feature)

    def tune(self, ds: Dataset, spec=None, cv: CV | None = None) -> Tuned:
        """Least cross-validated RMSE over the grid; leave-one-out when no scheme is given.

        Scaling statistics come from all calibration rows, before the folds.
        """
        cv = cv or CV("loocv")
        ds, scale, feature = self._prepared(ds)
        responses = linear.response_count(ds)
        cal = ds.cal
        if ds.has("split"):
            cal, n = with_index(cal.withColumnRenamed("ix", "_ix"), ["_ix"])
        else:
            n = cal.agg(F.max("ix").alias("m")).first()["m"] + 1
        values = candidates(self.kind, spec, n, ds.width, self.hp.get("method", "knn"))
        if self.kind == "ols":
            values = [0.0]
        if self.kind in linear.PATH_KINDS + ("kernel_pls",):
            hp = self._linear_hp()
            wide = linear.cross_predict(cal, self._linear_kind(), values, cv, ds.width, n, **hp)
            held = long_predictions(wide, values, responses)
            m = moments(ds.cal, "x", "y", width=ds.width)[""]
            fits = linear.path(self._linear_kind(), m, values, **hp)
            whole = linear.predict_path(ds.df, fits)
            keep = ("ix", "split") if ds.has("split") else ("ix",)
            whole = long_predictions(whole, values, responses, keep)
            models = dict(zip(values, fits))
        elif self.kind == "local" and cv.partitions:
            held, whole, models = self._local_search(ds, cal, n, values, cv, responses)
        else:
            held, whole, models = self._search(ds, cal, n, values, cv, responses)
        curve_cv = curve(held)
        best = min(curve_cv.collect(), key=lambda r: (r["rmse"], r["candidate"]))["candidate"]
        own = curve(whole.filter("split = 'cal'")) if ds.has("split") else curve(whole)
        val = curve(whole.filter("split = 'val'")) if ds.has("split") else None
        chosen = models.get(best) or self._fit_other(ds.cal, best, ds.width, responses)
        return Tuned(best, curve_cv, held, own, val, Fitted(self.kind, best, chosen, scale, feature))

    def _local_search(self, ds, cal, n, values, cv, responses):
        """One neighbour join that leaves each row's own fold out, for all folds at once."""
        hp = {k: v for k, v in self.hp.items() if k != "method"}
        method = self.hp.get("method", "knn")
        folds = assign(cal, cv, n).select("ix", "x", "y", "fold")
        held = neighbors.local_path(folds, folds, method, values, ds.width, responses, "fold", **hp)
        # read for the choice and again for the curve
        held = durable(long_predictions(folds.drop("x").join(held, "ix"), values, responses))
        own = neighbors.local_path(ds.df, ds.cal, method, values, ds.width, responses, **hp)
        keep = ("ix", "split") if ds.has("split") else ("ix",)
        whole = long_predictions(ds.df.drop("x").join(own, "ix"), values, responses, keep)
        return held, whole, {}

    def _search(self, ds, cal, n, values, cv, responses):
        """Candidate by candidate and fold by fold, for models that must be refitted."""
        assigned = assign(cal, cv, n)
        if cv.strategy == "loocv":
            raise ValueError("leave-one-out refits per row: choose folds for this model")
        held = whole = None
        models = {}
        flat = lambda df, v, keep: long_predictions(df, [v], responses, keep)
        for v in values:
            model = self._fit_other(ds.cal, v, ds.width, responses)
            models[v] = model
            keep = ("ix", "split") if ds.has("split") else ("ix",)
            own = model.predict(ds.df)
            train, test = training_rows(assigned), test_rows(assigned)
            for f in range(cv.k * (cv.repeats if cv.strategy == "repeated_kfold" else 1)):
                rows = train.filter(F.col("fold") == f)
                if "train_weights" in assigned.columns:  # a row drawn w times counts w times
                    rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_t")
                fold_model = self._fit_other(rows.select("ix", "x", "y"), v, ds.width, responses)
                part = fold_model.predict(test.filter(F.col("fold") == f).select("ix", "x", "y", "fold"))
                part = flat(part, v, ("ix", "fold"))
                held = part if held is None else held.unionByName(part)
            own = flat(own, v, keep)
            whole = own if whole is None else whole.unionByName(own)
        return held, whole, models


def coefficients(fit: LinearFit, spark, names=None) -> DataFrame:
    """(variable, response, coefficient) rows of a linear fit, then its intercepts."""
    p, q = fit.coef.shape
    names = names or [f"V{i + 1}" for i in range(p)]
    rows = [(names[i], j, float(fit.coef[i, j])) for i in range(p) for j in range(q)]
    rows += [("(intercept)", j, float(fit.intercept[j])) for j in range(q)]
    return spark.createDataFrame(rows, "variable string, response int, coefficient double")
