"""Queries of the latent, regression, classification, one-class, multiway and ensemble models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators import (discriminant, ensemble, kernels, latent, linear, mcr, metrics, neighbors, novelty, npls, ordering,
                         parafac, preprocess, trees)
from ..operators.calibration import Calibration, coefficients
from ..operators.classification import Classifier
from ..operators.folds import CV
from ..operators.moments import moments
from .registry import INDEXED, LINE_ORDER, LONG, WIDTH, query, r6, regression_spectra, spectra, table

_CV5 = CV("venetian_blinds", 5)


def _first(name: str = "yhat"):
    return F.get(name, F.lit(0))


# --- principal components -----------------------------------------------------------------

def _scaled(spark, folder):
    ds, _ = preprocess.scale(preprocess.snv(spectra(spark, folder)), "autoscale")
    return ds


@query("pca_t2_q")
def pca_t2_q(spark, folder):
    """SNV, autoscaling and five principal components of all spectra."""
    ds = _scaled(spark, folder)
    scored = latent.pca(ds, 5).transform(ds.df)
    return scored.select(F.col("ix").alias("vec_id"), "label", r6("t2").alias("t2"), r6("q").alias("q"))


@query("pca_scores")
def pca_scores(spark, folder):
    ds = _scaled(spark, folder)
    model = latent.pca(ds, 5)
    scored = model.leverage(model.transform(ds.df))
    return scored.select(F.col("ix").alias("vec_id"), r6("leverage").alias("leverage"),
                         *[r6(F.get("scores", F.lit(i))).alias(f"t{i + 1}") for i in range(5)])


@query("pca_metrics")
def pca_metrics(spark, folder):
    ds = _scaled(spark, folder)
    m = latent.pca(ds, 10).metrics(ds.df)
    rows = [(i + 1, *map(float, v)) for i, v in enumerate(zip(m["explained_variance"], m["percent"], m["cumulative"],
                                                              m["reconstruction_rmse"]))]
    return spark.createDataFrame(rows, "component int, variance double, percent double, cumulative double, rmse double")


@query("pca_cv_curve")
def pca_cv_curve(spark, folder):
    ds = _scaled(spark, folder)
    _, curve, _ = latent.pca_cv(ds, 10, _CV5)
    return curve


_TWO = """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_extendedprice / 1000) AS mb, var_samp(l_quantity) AS va,
var_samp(l_extendedprice / 1000) AS vb, covar_samp(l_quantity, l_extendedprice / 1000) AS c FROM lineitem),
e AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) AS l1, (va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + c * c) AS l2 FROM s),
u AS (SELECT *, sqrt(c * c + (l1 - va) ** 2) AS norm FROM e),
w AS (SELECT *, c / norm * CASE WHEN (abs(c) >= abs(l1 - va) AND c < 0) OR (abs(c) < abs(l1 - va) AND l1 < va) THEN -1 ELSE 1 END AS wa,
(l1 - va) / norm * CASE WHEN (abs(c) >= abs(l1 - va) AND c < 0) OR (abs(c) < abs(l1 - va) AND l1 < va) THEN -1 ELSE 1 END AS wb FROM u)"""


def _two_variables(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"),
        F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"))


@query("pca_two_variables", _TWO + """
SELECT l_orderkey, l_linenumber, round(wa * (l_quantity - ma) + wb * (l_extendedprice / 1000 - mb), 6) + 0.0 AS t1,
round((wa * (l_quantity - ma) + wb * (l_extendedprice / 1000 - mb)) ** 2 / l1, 6) + 0.0 AS t2,
round((wb * (l_quantity - ma) - wa * (l_extendedprice / 1000 - mb)) ** 2, 6) + 0.0 AS q FROM lineitem, w""")
def pca_two_variables(spark, folder):
    """Quantity and price: the one case of two variables has a closed form to compare with."""
    ds = Dataset(_two_variables(spark, folder), (2,))
    scored = latent.pca(ds, 1).transform(ds.df)
    return scored.select("l_orderkey", "l_linenumber", r6(_first("scores")).alias("t1"), r6("t2").alias("t2"), r6("q").alias("q"))


@query("pca_explained", _TWO + """
SELECT 1 AS component, round(l1, 6) AS variance, round(100 * l1 / (va + vb), 6) AS percent, round(100 * l1 / (va + vb), 6) AS cumulative FROM w
UNION ALL SELECT 2, round(l2, 6), round(100 * l2 / (va + vb), 6), 100.0 FROM w""")
def pca_explained(spark, folder):
    ds = Dataset(_two_variables(spark, folder), (2,))
    out = latent.pca(ds, 2).explained(spark)
    return out.select("component", *[r6(c).alias(c) for c in ("variance", "percent", "cumulative")])


@query("pca_reconstruction", _TWO + """
SELECT 1 AS component, round(sqrt(avg((wb * (l_quantity - ma) - wa * (l_extendedprice / 1000 - mb)) ** 2) / 2), 6) AS rmse FROM lineitem, w""")
def pca_reconstruction(spark, folder):
    ds = Dataset(_two_variables(spark, folder), (2,))
    m = latent.pca(ds, 1).metrics(ds.df)
    return spark.createDataFrame([(1, float(m["reconstruction_rmse"][0]))], "component int, rmse double") \
        .select("component", r6("rmse").alias("rmse"))


# --- linear calibration -------------------------------------------------------------------

_X = ["l_quantity", "l_discount", "l_tax"]


def _line_samples(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(*_X).alias("x"), F.array("l_extendedprice").alias("y"))
    return Dataset(df, (3,), y_names=("l_extendedprice",))


def _normal_sql(penalty: float, divide: bool = False) -> str:
    """Coefficients of three variables by Cramer's rule on centred sums."""
    n = "count(*)"
    c = lambda a, b: f"covar_pop({a}, {b}) * {n}"
    sums = ", ".join(f"{c(_X[i], _X[j])} + {penalty if i == j else 0.0} AS s{i}{j}" for i in range(3) for j in range(3))
    right = ", ".join(f"{c(x, 'l_extendedprice')} AS y{i}" for i, x in enumerate(_X))
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(_X))

    def det(cols):
        a, b, d = cols
        return (f"({a}0 * ({b}1 * {d}2 - {b}2 * {d}1) - {b}0 * ({a}1 * {d}2 - {a}2 * {d}1) + {d}0 * ({a}1 * {b}2 - {a}2 * {b}1))")

    base = ["s0", "s1", "s2"]
    whole = det(base)
    parts = []
    for i in range(3):
        cols = list(base)
        cols[i] = "y"
        parts.append(f"{det(cols)} / {whole} AS b{i}")
    return (f"WITH s AS (SELECT {sums}, {right}, {means}, avg(l_extendedprice) AS my FROM lineitem), "
            f"b AS (SELECT *, {', '.join(parts)} FROM s)")


def _coefficient_sql(penalty):
    rows = " UNION ALL ".join(f"SELECT '{x}' AS variable, round(b{i}, 4) + 0.0 AS coefficient FROM b" for i, x in enumerate(_X))
    return (_normal_sql(penalty) + f" {rows} UNION ALL SELECT '(intercept)', round(my - b0 * m0 - b1 * m1 - b2 * m2, 4) + 0.0 FROM b")


def _coefficients(kind, value):
    def run(spark, folder):
        fitted = Calibration(kind, value).fit(Dataset(_line_samples(spark, folder).df, (3,), y_names=("p",), scaled=True))
        rows = coefficients(fitted.model, spark, _X)
        return rows.select("variable", r6("coefficient", 4).alias("coefficient"))

    return run


query("ols_multi", _coefficient_sql(0.0))(_coefficients("ols", None))
query("ridge_multi", _coefficient_sql(25.0))(_coefficients("ridge", 25.0))


@query("ols_predict", _normal_sql(0.0) + """
SELECT l_orderkey, l_linenumber, round(my + b0 * (l_quantity - m0) + b1 * (l_discount - m1) + b2 * (l_tax - m2), 3) + 0.0 AS yhat FROM lineitem, b""")
def ols_predict(spark, folder):
    ds = _line_samples(spark, folder)
    return Calibration("ols").fit(ds).predict(ds.df).select("l_orderkey", "l_linenumber", r6(_first(), 3).alias("yhat"))


_PLS1 = f"""
WITH {LONG}, y AS (SELECT vec_id, v - avg(v) OVER () AS y, avg(v) OVER () AS my FROM long WHERE pos = 0),
x AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY pos) AS x FROM long WHERE pos > 0),
s AS (SELECT pos, sum(x * y) AS s FROM x JOIN y USING (vec_id) GROUP BY pos),
w AS (SELECT pos, s / sqrt(sum(s * s) OVER ()) AS w FROM s),
t AS (SELECT vec_id, sum(x * w) AS t FROM x JOIN w USING (pos) GROUP BY vec_id),
q AS (SELECT sum(t * y) / sum(t * t) AS q, sum(t * t) AS tt, count(*) AS n FROM t JOIN y USING (vec_id))"""


@query("pls_one_component", _PLS1 + " SELECT vec_id, round(my + q * t, 6) + 0.0 AS yhat FROM t JOIN y USING (vec_id), q")
def pls_one_component(spark, folder):
    ds = regression_spectra(spark, folder)
    return Calibration("pls", 1).fit(ds).predict(ds.df).select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))


@query("pls_diagnostics", _PLS1 + f""", p AS (SELECT pos, sum(x * t) / any_value(tt) AS p FROM x JOIN t USING (vec_id), q GROUP BY pos),
r AS (SELECT vec_id, sum((x - t * p) ** 2) AS q FROM x JOIN t USING (vec_id) JOIN p USING (pos) GROUP BY vec_id)
SELECT vec_id, round(t * t / tt, 6) + 0.0 AS leverage, round((n - 1) * t * t / tt, 6) + 0.0 AS t2, round(r.q, 6) + 0.0 AS q
FROM t JOIN r USING (vec_id), q""")
def pls_diagnostics(spark, folder):
    ds = regression_spectra(spark, folder)
    fit = Calibration("pls", 1).fit(ds).model
    done = linear.diagnostics(ds.df, fit.parts["projection"])
    return done.select(F.col("ix").alias("vec_id"), r6("leverage").alias("leverage"), r6("t2").alias("t2"), r6("q").alias("q"))


def _tuned_curve(kind, spec, **hp):
    def run(spark, folder):
        return Calibration(kind, **hp).tune(regression_spectra(spark, folder), spec, _CV5).curve

    return run


query("pls_curve")(_tuned_curve("pls", "10"))
query("pcr_curve")(_tuned_curve("pcr", "10"))
query("lasso_curve")(_tuned_curve("lasso", "0.001, 0.01, 0.1"))
query("elastic_net_curve")(_tuned_curve("elastic_net", "0.001, 0.01, 0.1", l1_ratio=0.5))
query("kernel_pls_curve")(_tuned_curve("kernel_pls", "5", gamma=0.005, size=100))
query("local_curve")(_tuned_curve("local", "3, 5, 9", method="knn"))


@query("pls_two_responses")
def pls_two_responses(spark, folder):
    """The first two values from the other 62, three components."""
    ds = spectra(spark, folder)
    df = ds.df.withColumn("y", F.slice("x", 1, 2)).withColumn("x", F.slice("x", 3, WIDTH - 2))
    ds = Dataset(df, (WIDTH - 2,), y_names=("a", "b"))
    done = Calibration("pls", 3, scale=True).fit(ds).predict(ds.df)
    return done.select(F.col("ix").alias("vec_id"), r6(_first()).alias("a"), r6(F.get("yhat", F.lit(1))).alias("b"))


@query("pls_loocv")
def pls_loocv(spark, folder):
    """Leave-one-out predictions of three components: one downdate per row."""
    ds = regression_spectra(spark, folder)
    wide = linear.cross_predict(ds.df, "pls", [3], CV("loocv"), ds.width)
    return wide.select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))


def _predictions(kind, value, **hp):
    def run(spark, folder):
        ds = regression_spectra(spark, folder)
        done = Calibration(kind, value, **hp).fit(ds).predict(ds.df)
        return done.select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))

    return run


query("random_forest_predict")(_predictions("random_forest", 20, depth=6))
query("gradient_boosting_predict")(_predictions("gradient_boosting", 10, depth=3))
query("hist_boosting_predict")(_predictions("hist_gradient_boosting", 10, max_bins=32))
query("svr_predict")(_predictions("svr", 1.0, epsilon=0.05, gamma=0.01, size=128))
query("svr_linear_predict")(_predictions("svr", 1.0, epsilon=0.05, kernel="linear"))


@query("gaussian_process_predict")
def gaussian_process_predict(spark, folder):
    ds = regression_spectra(spark, folder)
    done = Calibration("gaussian_process", 1e-2, length_scale=8.0, size=200).fit(ds).predict(ds.df)
    return done.select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"), r6(_first("sd")).alias("sd"))


# --- classification -----------------------------------------------------------------------

@query("lda_two_variables", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem),
g AS (SELECT k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS va, var_pop(b) * count(*) AS vb,
covar_pop(a, b) * count(*) AS c FROM v GROUP BY k),
p AS (SELECT sum(va) / (sum(n) - count(*)) AS va, sum(vb) / (sum(n) - count(*)) AS vb, sum(c) / (sum(n) - count(*)) AS c, sum(n) AS n FROM g),
w AS (SELECT k, (p.vb * ma - p.c * mb) / (p.va * p.vb - p.c * p.c) AS wa, (p.va * mb - p.c * ma) / (p.va * p.vb - p.c * p.c) AS wb,
ma, mb, ln(g.n / p.n) AS prior FROM g, p),
d AS (SELECT l_orderkey, l_linenumber, v.a, v.b, w.k, wa * v.a + wb * v.b - 0.5 * (wa * ma + wb * mb) + prior AS d FROM v, w),
e AS (SELECT l_orderkey, l_linenumber, a, b, max(d) FILTER (k = 'A') AS da, max(d) FILTER (k = 'N') AS dn, max(d) FILTER (k = 'R') AS dr FROM d GROUP BY 1, 2, 3, 4)
SELECT l_orderkey, l_linenumber, round(a, 2) AS a, round(b, 5) AS b, round(exp(da) / (exp(da) + exp(dn) + exp(dr)), 6) AS p_a FROM e""")
def lda_two_variables(spark, folder):
    df = _two_variables(spark, folder).withColumn("a", _first("x")).withColumn("b", F.get("x", F.lit(1)))
    rule = Classifier("lda").fit(Dataset(df, (2,)), "label")
    done = rule.predict(df).select("l_orderkey", "l_linenumber", r6("a", 2).alias("a"), r6("b", 5).alias("b"),
                                   r6(_first("proba")).alias("p_a"))
    return done.distinct()


@query("qda_two_variables", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem),
g AS (SELECT k, count(*) AS n, sum(count(*)) OVER () AS t, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM v GROUP BY k),
d AS (SELECT l_orderkey, l_linenumber, v.a, v.b, g.k, -0.5 * ((vb * (v.a - ma) ** 2 - 2 * c * (v.a - ma) * (v.b - mb) + va * (v.b - mb) ** 2)
/ (va * vb - c * c) + ln(va * vb - c * c)) + ln(n / t) AS d FROM v, g),
e AS (SELECT l_orderkey, l_linenumber, a, b, max(d) FILTER (k = 'A') AS da, max(d) FILTER (k = 'N') AS dn, max(d) FILTER (k = 'R') AS dr FROM d GROUP BY 1, 2, 3, 4)
SELECT l_orderkey, l_linenumber, round(a, 2) AS a, round(b, 5) AS b, round(exp(da) / (exp(da) + exp(dn) + exp(dr)), 6) AS p_a FROM e""")
def qda_two_variables(spark, folder):
    df = _two_variables(spark, folder).withColumn("a", _first("x")).withColumn("b", F.get("x", F.lit(1)))
    rule = Classifier("qda").fit(Dataset(df, (2,)), "label")
    done = rule.predict(df).select("l_orderkey", "l_linenumber", r6("a", 2).alias("a"), r6("b", 5).alias("b"),
                                   r6(_first("proba")).alias("p_a"))
    return done.distinct()


def _class_table(method, **hp):
    def run(spark, folder):
        ds = spectra(spark, folder)
        model = Classifier(method, **hp).fit(ds, "label")
        return discriminant.result_table(model.predict(ds.df), "label", model.classes).withColumnRenamed("ix", "vec_id")

    return run


query("lda_predict")(_class_table("lda"))
query("lda_shrinkage_predict")(_class_table("lda", solver="lsqr", shrinkage="auto"))
query("qda_predict")(_class_table("qda", reg=0.1))
query("plsda_predict")(_class_table("pls_da", components=5))
query("logistic_predict")(_class_table("logistic", c=1.0, balanced=True))
query("forest_classify")(_class_table("random_forest", trees=20, depth=6, criterion="entropy"))
query("extra_trees_classify")(_class_table("extra_trees", trees=10, depth=5))
query("svc_classify")(_class_table("svc", kernel="linear", c=1.0, max_iter=30))
query("svc_rbf_classify")(_class_table("svc", kernel="rbf", gamma=1.0, size=128, c=1.0, max_iter=30))


def _class_cv(method, cv, **hp):
    def run(spark, folder):
        ds = spectra(spark, folder)
        held = Classifier(method, **hp).cross_validate(ds, "label", cv)
        m = metrics.class_metrics(held, "label", "pred")
        return m.select(F.lit(method).alias("method"), *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])

    return run


query("lda_cv")(_class_cv("lda", _CV5))
query("plsda_loocv")(_class_cv("pls_da", CV("loocv"), components=3))
query("knn_cv")(_class_cv("knn", CV("loocv"), k=5))
query("qda_stratified_cv")(_class_cv("qda", CV("stratified_kfold", 5), reg=0.5))


# --- one-class ----------------------------------------------------------------------------

_SIMCA = """
WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_quantity AS a, l_extendedprice AS b FROM lineitem),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, corr(a, b) AS r, count(*) AS n FROM v WHERE k = 'R'),
d AS (SELECT l_orderkey, l_linenumber, k, ((a - ma) / sa + sign(r) * (b - mb) / sb) ** 2 / 2 / (1 + abs(r)) AS t2,
((a - ma) / sa - sign(r) * (b - mb) / sb) ** 2 / 2 AS q, n FROM v, s),
l AS (SELECT quantile_cont(q, 0.95) AS ql, quantile_cont(t2, 0.95) AS tl, avg(t2 / (n - 1)) AS h0, avg(q) AS q0,
greatest(1, least(250, round(2 * avg(t2 / (n - 1)) ** 2 / var_samp(t2 / (n - 1))))) AS nh,
greatest(1, least(250, round(2 * avg(q) ** 2 / var_samp(q)))) AS nq FROM d WHERE k = 'R')"""


def _reference(spark, folder):
    df, _ = ordering.with_index(table(spark, folder, "lineitem").select(*LINE_ORDER), LINE_ORDER)
    df = df.select("ix", "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"),
                   F.array("l_quantity", "l_extendedprice").alias("x"))
    return df, df.filter("label = 'R'")


@query("simca_two_variables", _SIMCA + """
SELECT l_orderkey, l_linenumber, round(q, 6) + 0.0 AS q, round(t2, 6) + 0.0 AS t2,
CASE WHEN q <= ql AND t2 <= tl THEN 1 ELSE -1 END AS inlier, round(least((ql - q) / ql, (tl - t2) / tl), 5) + 0.0 AS score FROM d, l""")
def simca_two_variables(spark, folder):
    df, reference = _reference(spark, folder)
    model = novelty.fit_novelty(reference, "simca", 2, components=1, scale=True, limits="empirical")
    done = novelty.score_novelty(model, df)
    return done.select("l_orderkey", "l_linenumber", r6("q").alias("q"), r6("t2").alias("t2"), "inlier", r6("score", 5).alias("score"))


@query("simca_combined", _SIMCA + """
SELECT l_orderkey, l_linenumber, CASE WHEN sqrt((q / ql) ** 2 + (t2 / tl) ** 2) <= 1 THEN 1 ELSE -1 END AS inlier,
round(1 - sqrt((q / ql) ** 2 + (t2 / tl) ** 2), 5) + 0.0 AS score FROM d, l""")
def simca_combined(spark, folder):
    df, reference = _reference(spark, folder)
    model = novelty.fit_novelty(reference, "simca", 2, components=1, scale=True, limits="empirical", rule="combined", combine="l2")
    return novelty.score_novelty(model, df).select("l_orderkey", "l_linenumber", "inlier", r6("score", 5).alias("score"))


@query("ddsimca_distance", _SIMCA + """
SELECT l_orderkey, l_linenumber, round(t2 / (n - 1) / h0 * nh + q / q0 * nq, 5) + 0.0 AS f FROM d, l""")
def ddsimca_distance(spark, folder):
    df, reference = _reference(spark, folder)
    model = novelty.fit_novelty(reference, "dd_simca", 2, components=1, scale=True)
    return novelty.score_novelty(model, df).select("l_orderkey", "l_linenumber", r6("f", 5).alias("f"))


@query("inlier_rate", _SIMCA + """
SELECT k AS label, round(avg(CASE WHEN q <= ql AND t2 <= tl THEN 1.0 ELSE 0 END), 6) AS inlier_rate FROM d, l GROUP BY k""")
def inlier_rate(spark, folder):
    df, reference = _reference(spark, folder)
    model = novelty.fit_novelty(reference, "simca", 2, components=1, scale=True, limits="empirical")
    done = novelty.score_novelty(model, df)
    return done.groupBy("label").agg(r6(F.avg((F.col("inlier") == 1).cast("int"))).alias("inlier_rate"))


def _one_class(method, **hp):
    def run(spark, folder):
        ds = spectra(spark, folder)
        reference = novelty.reference_class(ds.df.withColumn("label", F.col("label").cast("int")), "label", 3)
        rows = ds.df.filter(F.col("label") == reference)
        model = novelty.fit_novelty(rows.select("ix", "x"), method, ds.width, **hp)
        done = novelty.score_novelty(model, ds.df)
        done = novelty.probabilities(novelty.remap_truth(done, "label", reference).persist())
        extra = ["region"] if "region" in done.columns else []
        return done.select(F.col("ix").alias("vec_id"), "truth", "inlier", r6("score").alias("score"),
                           r6("p_reference").alias("p_reference"), *extra)

    return run


query("simca_flags")(_one_class("simca", components=3))
query("ddsimca_regions")(_one_class("dd_simca", components=3))
query("ddsimca_robust")(_one_class("dd_simca", components=3, limits="robust"))
query("isolation_forest")(_one_class("isolation_forest", trees=50))
query("lof_novelty")(_one_class("lof", k=10))
query("one_class_svm")(_one_class("one_class_svm", nu=0.1, gamma=0.5, size=128))


@query("mcd_envelope")
def mcd_envelope(spark, folder):
    """Robust covariance of quantity, discount and tax over all lines."""
    df, _ = ordering.with_index(table(spark, folder, "lineitem").select(*LINE_ORDER), LINE_ORDER)
    df = df.select("ix", "l_orderkey", "l_linenumber", F.array(*_X).alias("x"))
    model = novelty.fit_novelty(df, "elliptic_envelope", 3)
    return novelty.score_novelty(model, df).select("l_orderkey", "l_linenumber", "inlier", r6("score", 4).alias("score"))


@query("simca_cv")
def simca_cv(spark, folder):
    ds = spectra(spark, folder)
    done = novelty.novelty_cv(ds.df, F.col("label") == "3", "simca", ds.width, _CV5, components=3)
    return done.select(F.col("ix").alias("vec_id"), "inlier", r6("score").alias("score"), "out_of_fold")


# --- multiway -----------------------------------------------------------------------------

def _positive(spark, folder, shape):
    ds = spectra(spark, folder, shape)
    return ds.with_df(ds.df.withColumn("y", F.slice("x", 1, 2)).withColumn("x", F.transform("x", lambda v: F.abs(v))),
                      y_names=("a", "b"))


@query("mcr_als")
def mcr_als(spark, folder):
    ds = _positive(spark, folder, (WIDTH,))
    model = mcr.mcr_als(ds, 3, max_iter=30, tol=1e-6)
    return model.transform(ds.df).select(F.col("ix").alias("vec_id"), r6("sse", 4).alias("sse"),
                                         *[r6(F.get("scores", F.lit(i)), 4).alias(f"c{i + 1}") for i in range(3)])


@query("mcr_augmented")
def mcr_augmented(spark, folder):
    """8 × 8 samples: the second way is spectral, the first augments the rows; areas per sample."""
    ds = _positive(spark, folder, (8, 8))
    model = mcr.mcr_als(ds, 2, spectral_way=2, max_iter=20, tol=1e-6)
    scored = model.transform(ds.df)
    lines = mcr.calibrate_scores(scored, 2)
    return mcr.paired_predictions(scored, lines).select(
        F.col("ix").alias("vec_id"), "component", "response", *[r6(c, 4).alias(c) for c in ("pred", "true", "err")])


def _halved(ds):
    """Every fourth sample validates."""
    return ds.with_df(ds.df.withColumn("split", F.when(F.col("ix") % 4 == 0, "val").otherwise("cal")))


def _refitted(rows, similar):
    """Scores of each validation sample's own model, and how alike that model is to all others."""
    near = similar.totals.select("ix", (F.col("total") / F.col("models")).alias("alike"), "models")
    return (rows.join(near, "ix").select(F.col("ix").alias("vec_id"), r6("sfit", 4).alias("sfit"), r6("alike", 4).alias("alike"), "models",
                                         F.posexplode("scores").alias("component", "score")).withColumn("score", r6("score", 3)))


@query("mcr_sample_refits")
def mcr_sample_refits(spark, folder):
    """A model for each validation sample with all calibration samples, components in the order of the medoid."""
    ds = _halved(_positive(spark, folder, (WIDTH,)))
    return _refitted(*mcr.sample_refits(ds, mcr.mcr_als(ds, 2, max_iter=10, tol=1e-6, joint=False), max_iter=3))


@query("parafac_sample_refits")
def parafac_sample_refits(spark, folder):
    """As for the bilinear model, with 8 x 8 samples."""
    ds = _halved(_positive(spark, folder, (8, 8)))
    model = parafac.parafac(ds.with_df(ds.cal), 2, {m: {"non_negative": 1} for m in range(3)}, max_iter=10, tol=1e-6)
    return _refitted(*parafac.sample_refits(ds, model, max_iter=3))


@query("parafac_cp")
def parafac_cp(spark, folder):
    ds = spectra(spark, folder, (8, 8))
    model = parafac.parafac(ds, 2, max_iter=30, tol=1e-6)
    return model.transform(ds.df).select(F.col("ix").alias("vec_id"), r6("sse", 4).alias("sse"),
                                         *[r6(F.get("scores", F.lit(i)), 4).alias(f"a{i + 1}") for i in range(2)])


@query("parafac_missing")
def parafac_missing(spark, folder):
    """Values above 0.25 count as saturated and are left out; non-negative factors."""
    ds = _positive(spark, folder, (8, 8))
    ds = ds.with_x(F.transform("x", lambda v: F.when(v > 0.25, float("nan")).otherwise(v)))
    model = parafac.parafac(ds, 2, {m: {"non_negative": 1} for m in range(3)}, max_iter=20, tol=1e-6)
    return model.transform(ds.df).select(F.col("ix").alias("vec_id"), r6("sse", 4).alias("sse"))


@query("parafac_rank_sweep")
def parafac_rank_sweep(spark, folder):
    return parafac.rank_sweep(spectra(spark, folder, (8, 8)), [1, 2, 3], max_iter=10, tol=1e-6)


def _npls_dataset(spark, folder):
    """The first value from the other 63, arranged 9 × 7."""
    ds = regression_spectra(spark, folder)
    return Dataset(ds.df, (9, 7), y_names=("y",))


@query("npls")
def npls_query(spark, folder):
    ds = _npls_dataset(spark, folder)
    done = npls.npls(ds, 3).predict(ds.df)
    return done.select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"), r6(_first("leverage")).alias("leverage"))


@query("upls_one_component", _PLS1 + " SELECT vec_id, round(my + q * t, 6) + 0.0 AS yhat FROM t JOIN y USING (vec_id), q")
def upls_one_component(spark, folder):
    ds = _npls_dataset(spark, folder)
    return npls.npls(ds, 1, "u_pls").predict(ds.df).select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))


@query("npls_residual_bilinear")
def npls_residual_bilinear(spark, folder):
    """One unexpected component removed from every sample."""
    ds = _npls_dataset(spark, folder)
    done = npls.npls(ds, 2, "u_pls").predict(ds.df, interferents=1)
    return done.select(F.col("ix").alias("vec_id"), *[r6(_first(c), 4).alias(c) for c in ("yhat", "yhat_base", "norm_before", "norm_after")])


@query("npls_figures")
def npls_figures(spark, folder):
    ds = _npls_dataset(spark, folder)
    model = npls.npls(ds, 2)
    return model.figures(model.predict(ds.df), ds.cal).withColumnRenamed("ix", "vec_id")


# --- ensembles ----------------------------------------------------------------------------

_PARTS = [(0, 22), (22, 21), (43, 21)]


def _members(spark, folder):
    """Nearest-centroid members, each on its own range of variables."""
    ds = spectra(spark, folder)
    out = []
    for start, size in _PARTS:
        part = ds.df.select("ix", "label", F.slice("x", start + 1, size).alias("x"))
        rule = discriminant.centroid_rule(part, "label", size)
        out.append((rule.classes, rule.predict(part)))
    return out


_MEMBER_SQL = f"""
WITH {LONG}, c AS (SELECT label AS k, pos, avg(v) AS m FROM long GROUP BY 1, 2),
d AS (SELECT vec_id, CAST(k AS VARCHAR) AS k, CASE WHEN pos < 22 THEN 0 WHEN pos < 43 THEN 1 ELSE 2 END AS member,
sqrt(sum((v - m) ** 2)) AS d FROM long JOIN c USING (pos) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, member, k AS pred FROM d QUALIFY row_number() OVER (PARTITION BY vec_id, member ORDER BY d, k) = 1),
soft AS (SELECT vec_id, member, k, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id, member) AS p FROM d)"""


def _vote_sql(weights):
    w = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(weights))
    return _MEMBER_SQL + f""", t AS (SELECT vec_id, pred, sum(CASE member {w} END) AS votes, min(member) AS first FROM p GROUP BY 1, 2)
SELECT vec_id, pred, votes::DOUBLE AS votes FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, first) = 1"""


def _hard(weights):
    def run(spark, folder):
        members = [m.select("ix", "pred") for _, m in _members(spark, folder)]
        return ensemble.hard_vote(members, weights).withColumnRenamed("ix", "vec_id")

    return run


query("hard_vote", _vote_sql([1.0, 1.0, 1.0]))(_hard(None))
query("weighted_vote", _vote_sql([1.0, 1.5, 2.0]))(_hard([1.0, 1.5, 2.0]))


@query("soft_vote", _MEMBER_SQL + """, s AS (SELECT vec_id, k, sum(p) / 3 AS p FROM soft GROUP BY 1, 2)
SELECT vec_id, k AS pred, round(p, 6) AS p FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) = 1""")
def soft_vote(spark, folder):
    members = [ensemble.long_probabilities(m, classes) for classes, m in _members(spark, folder)]
    return ensemble.soft_vote(members).select(F.col("ix").alias("vec_id"), "pred", r6("p").alias("p"))


_PAIRS = """
WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2:] AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT a.vec_id, b.y, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r
FROM s a JOIN s b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, avg(y) FILTER (r <= 3) AS a, avg(y) FILTER (r <= 9) AS b,
sum(y / d) FILTER (r <= 5) / sum(1 / d) FILTER (r <= 5) AS c FROM near GROUP BY vec_id)"""


def _regression_members(spark, folder):
    ds = regression_spectra(spark, folder)
    out = []
    near = neighbors.shared_neighbors(ds.df, ds.df, 9, ds.width, "ix")
    for hp in (dict(method="knn", k=3), dict(method="knn", k=9), dict(method="idw", k=5)):
        done = neighbors.local_predict(ds.df, ds.df, exclude="ix", width=ds.width, responses=1, near=near, **hp)
        out.append(done.select("ix", F.lit(0).alias("response"), _first().alias("yhat")))
    return out


def _combined(how, weights=None):
    def run(spark, folder):
        done = ensemble.combine_regression(_regression_members(spark, folder), how, weights)
        return done.select(F.col("ix").alias("vec_id"), r6("yhat").alias("yhat"))

    return run


query("ensemble_mean", _PAIRS + " SELECT vec_id, round((a + b + c) / 3, 6) + 0.0 AS yhat FROM m")(_combined("mean"))
query("ensemble_median", _PAIRS + " SELECT vec_id, round(a + b + c - greatest(a, b, c) - least(a, b, c), 6) + 0.0 AS yhat FROM m")(_combined("median"))
query("ensemble_weighted", _PAIRS + " SELECT vec_id, round((a + 2 * b + 3 * c) / 6, 6) + 0.0 AS yhat FROM m")(
    _combined("weighted_mean", [1, 2, 3]))


def _stack_parts(spark, folder):
    ds = regression_spectra(spark, folder)
    members = []
    for kind, value in (("pls", 2), ("pcr", 5), ("ridge", 1.0)):
        wide = linear.cross_predict(ds.df, kind, [value], _CV5, ds.width)
        members.append(wide.select("ix", F.col("yhat").alias("f")))
    return ds, members


@query("stacking_ridge")
def stacking_ridge(spark, folder):
    ds, members = _stack_parts(spark, folder)
    features = ensemble.stack_features(members)
    stack = ensemble.fit_stack(features, ds.df.select("ix", "y"), "ridge", alpha=0.1)
    return stack.predict(features).select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))


@query("stacking_passthrough")
def stacking_passthrough(spark, folder):
    """Members and the original variables feed a forest."""
    ds, members = _stack_parts(spark, folder)
    features = ensemble.stack_features(members, ds.df)
    stack = ensemble.fit_stack(features, ds.df.select("ix", "y"), "random_forest", trees=10, depth=4)
    return stack.predict(features).select(F.col("ix").alias("vec_id"), r6(_first()).alias("yhat"))


@query("stacking_classes")
def stacking_classes(spark, folder):
    """Out-of-fold probabilities of two members feed a logistic meta-learner."""
    ds = spectra(spark, folder)
    members = [discriminant.discriminant_cv(ds, "label", kind, _CV5, **hp).select("ix", F.col("proba").alias("f"))
               for kind, hp in (("lda", {}), ("pls_da", {"components": 3}))]
    features = ensemble.stack_features(members)
    stack = ensemble.fit_stack(features, ds.df.select("ix", "label"), "logistic", "classification")
    return stack.predict(features).select(F.col("ix").alias("vec_id"), "pred")


@query("sweep_neighbours", """
WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2:] AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT a.vec_id, a.y AS t, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r
FROM s a JOIN s b ON a.vec_id <> b.vec_id),
k AS (SELECT unnest([3, 5, 9]) AS k), p AS (SELECT k, vec_id, any_value(t) AS t, avg(y) AS p FROM near, k WHERE r <= k GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) AS sweep_value, round(sqrt(avg((t - p) ** 2)), 6) AS score FROM p GROUP BY k""")
def sweep_neighbours(spark, folder):
    ds = regression_spectra(spark, folder)
    near = neighbors.shared_neighbors(ds.df, ds.df, 9, ds.width, "ix")

    def run(k):
        done = neighbors.local_predict(ds.df, ds.df, "knn", k=k, exclude="ix", width=ds.width, responses=1, near=near)
        return done.join(ds.df.select("ix", "y"), "ix").select("ix", _first("y").alias("y"), _first().alias("yhat"))

    score = lambda df: metrics.regression_metrics(df).first()["rmse"]
    _, scores, _ = ensemble.sweep(run, [3, 5, 9], score)
    return scores.select("sweep_value", r6("score").alias("score"))


@query("branch_merge", f"""
WITH {LONG}, snv AS (SELECT vec_id, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10) AS v FROM long WINDOW w AS (PARTITION BY vec_id))
SELECT 'raw' AS branch, vec_id, round(sqrt(sum(v * v)), 6) AS norm FROM long GROUP BY vec_id
UNION ALL SELECT 'snv', vec_id, round(sqrt(sum(v * v)), 6) FROM snv GROUP BY vec_id""")
def branch_merge(spark, folder):
    from ..functions import vectors as V
    ds = spectra(spark, folder)
    norm = lambda df: df.select("ix", r6(F.sqrt(V.sum_squares("x"))).alias("norm"))
    out = ensemble.branches(ds.df, {"raw": norm, "snv": lambda df: norm(preprocess.snv(ds.with_df(df)).df)})
    return out.select("branch", F.col("ix").alias("vec_id"), "norm")
