"""Queries of splits, folds, cross-validation, metrics and joint regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators import ejcr as region
from ..operators import folds, linear, metrics, neighbors, ordering, splits, stats
from ..operators.discriminant import nearest_centroid
from ..operators.folds import CV
from .registry import (INDEXED, LINE_ORDER, LONG, WIDTH, query, r6, regression_spectra, spectra, table)


def _indexed(spark, folder, *columns):
    return ordering.with_index(table(spark, folder, "lineitem").select(*LINE_ORDER, *columns), LINE_ORDER)


def _fold_query(cv):
    def run(spark, folder):
        df, n = _indexed(spark, folder)
        done = folds.assign(df, cv, n)
        return done.select("ix", "l_orderkey", "l_linenumber", F.col("fold").cast("long").alias("fold"))

    return run


_K = 5
query("fold_kfold", f"""
WITH {INDEXED} SELECT ix, l_orderkey, l_linenumber, CASE WHEN ix < (n % {_K}) * (n // {_K} + 1) THEN ix // (n // {_K} + 1)
ELSE n % {_K} + (ix - (n % {_K}) * (n // {_K} + 1)) // (n // {_K}) END AS fold FROM indexed""")(
    _fold_query(CV("kfold", _K, shuffle=False)))
query("fold_venetian", f"WITH {INDEXED} SELECT ix, l_orderkey, l_linenumber, ix % {_K} AS fold FROM indexed")(
    _fold_query(CV("venetian_blinds", _K)))
query("fold_loocv", f"WITH {INDEXED} SELECT ix, l_orderkey, l_linenumber, ix AS fold FROM indexed")(
    _fold_query(CV("loocv")))


def _table_query(cv):
    def run(spark, folder):
        df, n = _indexed(spark, folder)
        rows = folds.fold_table(folds.assign(df.select("ix"), cv, n))
        return rows.select(F.col("fold").cast("long").alias("fold"), "ix", "role")

    return run


_TIME = f"(n - ({_K} - f) * (n // ({_K} + 1)))"
query("fold_timeseries", f"""
WITH {INDEXED}, f AS (SELECT unnest(range({_K})) AS f)
SELECT f AS fold, ix, CASE WHEN ix < {_TIME} THEN 'train' ELSE 'test' END AS role FROM indexed, f
WHERE ix < {_TIME} + n // ({_K} + 1)""")(_table_query(CV("timeseries", _K)))
query("fold_moving_window", f"""
WITH {INDEXED}, f AS (SELECT unnest(range({_K})) AS f),
a AS (SELECT *, greatest(1, n // ({_K} + 2)) AS w FROM indexed, f),
b AS (SELECT *, greatest(1, (n - w) // ({_K} + 1)) AS t FROM a),
c AS (SELECT *, greatest(0, n - w - t) AS last FROM b),
d AS (SELECT *, least(f * greatest(1, last // {_K - 1}), last) AS s FROM c)
SELECT f AS fold, ix, CASE WHEN ix < s + w THEN 'train' ELSE 'test' END AS role FROM d
WHERE ix >= s AND ix < least(s + w + t, n)""")(_table_query(CV("moving_window", _K)))


def _sizes_query(cv, expected):
    """Fold sizes of a shuffled strategy: the membership is random, the sizes are not."""

    def run(spark, folder):
        df, n = _indexed(spark, folder)
        rows = folds.fold_table(folds.assign(df.select("ix"), cv, n))
        return rows.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"))

    return run


_N = "(SELECT count(*) FROM lineitem)"
query("fold_kfold_shuffled", f"""
WITH f AS (SELECT unnest(range({_K})) AS f), s AS (SELECT f, {_N} // {_K} + CASE WHEN f < {_N} % {_K} THEN 1 ELSE 0 END AS t FROM f)
SELECT f AS fold, 'test' AS role, t AS n FROM s UNION ALL SELECT f, 'train', {_N} - t FROM s""")(
    _sizes_query(CV("kfold", _K), None))
query("fold_repeated_kfold", f"""
WITH f AS (SELECT unnest(range({3 * _K})) AS f), s AS (SELECT f, {_N} // {_K} + CASE WHEN f % {_K} < {_N} % {_K} THEN 1 ELSE 0 END AS t FROM f)
SELECT f AS fold, 'test' AS role, t AS n FROM s UNION ALL SELECT f, 'train', {_N} - t FROM s""")(
    _sizes_query(CV("repeated_kfold", _K, repeats=3), None))
query("fold_shuffle_split", f"""
WITH f AS (SELECT unnest(range({_K})) AS f), s AS (SELECT f, CAST(ceil({_N} * 0.2) AS BIGINT) AS t FROM f)
SELECT f AS fold, 'test' AS role, t AS n FROM s UNION ALL SELECT f, 'train', {_N} - t FROM s""")(
    _sizes_query(CV("shuffle_split", _K), None))


@query("fold_bootstrap", f"""
WITH f AS (SELECT unnest(range({_K})) AS f) SELECT f AS fold, {_N} AS drawn, {_N} AS covered FROM f""")
def fold_bootstrap(spark, folder):
    """Every split draws n rows in all, and each row is either drawn or tested."""
    df, n = _indexed(spark, folder)
    rows = folds.fold_table(folds.assign(df.select("ix"), CV("bootstrap", _K), n))
    return rows.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.sum(F.when(F.col("role") == "train", F.col("weight")).otherwise(0)).cast("long").alias("drawn"),
        F.count("*").alias("covered"))


@query("fold_stratified", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT o_orderkey, r % {_K} AS fold FROM o""")
def fold_stratified(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ix"), F.array("o_orderpriority").alias("classes"))
    done = folds.assign(df, CV("stratified_kfold", _K, shuffle=False))
    return done.select(F.col("ix").alias("o_orderkey"), F.col("fold").cast("long").alias("fold"))


# --- cross-validated metrics --------------------------------------------------------------

_FOLDS = f"f AS (SELECT unnest(range({_K})) AS f)"
_METRIC_SQL = """SELECT fold, count(*) AS n, round(sqrt(avg(e * e)), 4) + 0.0 AS rmse, round(avg(abs(e)), 4) + 0.0 AS mae,
round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) + 0.0 AS r2, round(avg(e), 4) + 0.0 AS bias, round(stddev_pop(e), 4) + 0.0 AS sep"""


def _line_samples(spark, folder, predictors):
    df, n = _indexed(spark, folder)
    df = df.select("ix", F.array(*predictors).alias("x"), F.array("l_extendedprice").alias("y"))
    return df, n


def _cv_metrics(kind, values):
    def run(spark, folder):
        df, n = _line_samples(spark, folder, ["l_quantity"])
        wide = linear.cross_predict(df, kind, values, CV("venetian_blinds", _K), 1, n)
        rows = wide.select("fold", F.get("y", F.lit(0)).alias("y"), F.get("yhat", F.lit(0)).alias("yhat"))
        m = metrics.regression_metrics(rows, by=["fold"])
        return m.select(F.col("fold").cast("long").alias("fold"), "n", r6("rmse", 4).alias("rmse"),
                        r6("mae", 4).alias("mae"), r6("r2").alias("r2"), r6("bias", 4).alias("bias"),
                        r6("sep", 4).alias("sep"))

    return run


def _cv_sql(slope):
    return f"""
WITH {INDEXED}, {_FOLDS}, m AS (SELECT f, {slope} AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx
FROM indexed, f WHERE ix % {_K} <> f GROUP BY f),
p AS (SELECT f AS fold, l_extendedprice AS y, my + b * (l_quantity - mx) - l_extendedprice AS e FROM indexed JOIN m ON ix % {_K} = f)
{_METRIC_SQL} FROM p GROUP BY fold"""


query("cv_ols_metrics", _cv_sql("regr_slope(l_extendedprice, l_quantity)"))(_cv_metrics("ols", [0]))
query("cv_ridge_metrics", _cv_sql("regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1000.0)"))(
    _cv_metrics("ridge", [1000.0]))
# with one variable the soft threshold acts on the covariance
query("cv_lasso_metrics", _cv_sql("""(covar_pop(l_extendedprice, l_quantity)
    - sign(covar_pop(l_extendedprice, l_quantity)) * least(50.0, abs(covar_pop(l_extendedprice, l_quantity)))) / var_pop(l_quantity)"""))(
    _cv_metrics("lasso", [50.0]))
query("cv_elastic_net_metrics", _cv_sql("""(covar_pop(l_extendedprice, l_quantity)
    - sign(covar_pop(l_extendedprice, l_quantity)) * least(25.0, abs(covar_pop(l_extendedprice, l_quantity)))) / (var_pop(l_quantity) + 25.0)"""))(
    _cv_metrics("elastic_net", [50.0]))


@query("cv_fold_summary", f"""
WITH {INDEXED}, {_FOLDS}, m AS (SELECT f, regr_slope(l_extendedprice, l_quantity) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx
FROM indexed, f WHERE ix % {_K} <> f GROUP BY f),
p AS (SELECT f AS fold, l_extendedprice AS y, my + b * (l_quantity - mx) - l_extendedprice AS e FROM indexed JOIN m ON ix % {_K} = f),
s AS (SELECT fold, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY fold)
SELECT 'rmse' AS metric, round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS std, round(min(rmse), 4) AS min, round(max(rmse), 4) AS max FROM s
UNION ALL SELECT 'r2', round(avg(r2), 4), round(stddev_pop(r2), 4), round(min(r2), 4), round(max(r2), 4) FROM s""")
def cv_fold_summary(spark, folder):
    df, n = _line_samples(spark, folder, ["l_quantity"])
    wide = linear.cross_predict(df, "ols", [0], CV("venetian_blinds", _K), 1, n)
    rows = wide.select("fold", F.get("y", F.lit(0)).alias("y"), F.get("yhat", F.lit(0)).alias("yhat"))
    out = metrics.fold_summary(metrics.regression_metrics(rows, by=["fold"]), ("rmse", "r2"))
    return out.select("metric", *[r6(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


@query("cv_ridge_curve", f"""
WITH {INDEXED}, {_FOLDS}, a AS (SELECT unnest([0.1, 10.0, 1000.0, 100000.0])::DOUBLE AS a),
m AS (SELECT f, a, regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + a) AS b,
avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM indexed, f, a WHERE ix % {_K} <> f GROUP BY f, a)
SELECT a AS candidate, round(sqrt(avg((my + b * (l_quantity - mx) - l_extendedprice) ** 2)), 4) AS rmse,
round(1 - sum((my + b * (l_quantity - mx) - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
FROM indexed JOIN m ON ix % {_K} = f GROUP BY a""")
def cv_ridge_curve(spark, folder):
    """The tuning curve of four penalties: two scans for all folds and candidates."""
    values = [0.1, 10.0, 1000.0, 100000.0]
    df, n = _line_samples(spark, folder, ["l_quantity"])
    wide = linear.cross_predict(df, "ridge", values, CV("venetian_blinds", _K), 1, n)
    out = linear.curve(linear.long_predictions(wide, values, 1))
    return out.select("candidate", r6("rmse", 4).alias("rmse"), r6("r2").alias("r2"))


@query("loocv_ols", """
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx,
regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT (l_extendedprice - a - b * l_quantity) / (1 - 1.0 / n - (l_quantity - mx) ** 2 / sxx) AS e FROM lineitem, s)
SELECT count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae FROM e""")
def loocv_ols(spark, folder):
    """Leave-one-out by downdating the moments in the task of each row."""
    df, n = _line_samples(spark, folder, ["l_quantity"])
    wide = linear.cross_predict(df, "ols", [0], CV("loocv"), 1, n)
    rows = wide.select(F.get("y", F.lit(0)).alias("y"), F.get("yhat", F.lit(0)).alias("yhat"))
    return metrics.regression_metrics(rows).select("n", r6("rmse", 4).alias("rmse"), r6("mae", 4).alias("mae"))


@query("cv_timeseries_metrics", f"""
WITH {INDEXED}, {_FOLDS}, m AS (SELECT f, regr_slope(l_extendedprice, l_quantity) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx
FROM indexed, f WHERE ix < {_TIME} GROUP BY f),
p AS (SELECT f AS fold, l_extendedprice AS y, my + b * (l_quantity - mx) - l_extendedprice AS e FROM indexed JOIN m
ON ix >= {_TIME} AND ix < {_TIME} + n // ({_K} + 1)) {_METRIC_SQL} FROM p GROUP BY fold""")
def cv_timeseries_metrics(spark, folder):
    df, n = _line_samples(spark, folder, ["l_quantity"])
    wide = linear.cross_predict(df, "ols", [0], CV("timeseries", _K), 1, n)
    rows = wide.select("fold", F.get("y", F.lit(0)).alias("y"), F.get("yhat", F.lit(0)).alias("yhat"))
    m = metrics.regression_metrics(rows, by=["fold"])
    return m.select(F.col("fold").cast("long").alias("fold"), "n", r6("rmse", 4).alias("rmse"),
                    r6("mae", 4).alias("mae"), r6("r2").alias("r2"), r6("bias", 4).alias("bias"), r6("sep", 4).alias("sep"))


# --- metrics ------------------------------------------------------------------------------

_FIXED = "l_quantity * (1 + l_tax) * 1000"


@query("regression_metrics", f"""
WITH p AS (SELECT l_returnflag, l_extendedprice AS y, {_FIXED} - l_extendedprice AS e FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(e), 4) AS bias, round(stddev_pop(e), 4) AS sep
FROM p GROUP BY 1""")
def regression_metrics(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("yhat", F.expr(_FIXED))
    m = metrics.regression_metrics(df, "l_extendedprice", "yhat", ["l_returnflag"])
    return m.select("l_returnflag", "n", *[r6(c, 6 if c == "r2" else 4).alias(c) for c in ("rmse", "mae", "r2", "bias", "sep")])


@query("residual_diag", f"""
WITH p AS (SELECT l_extendedprice - {_FIXED} AS e FROM lineitem)
SELECT round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(max(abs(e)), 4) AS max_abs FROM p""")
def residual_diag(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("yhat", F.expr(_FIXED))
    d = metrics.residual_diagnostics(df, "l_extendedprice", "yhat")
    return d.select(*[r6(c, 4).alias(c) for c in ("mean", "std", "max_abs")])


@query("ejcr_levels", f"""
WITH p AS (SELECT l_returnflag, l_extendedprice AS y, {_FIXED} AS f FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, regr_slope(f, y) AS m, regr_intercept(f, y) AS q, sum(y * y) AS a, sum(y) AS h,
(regr_syy(f, y) - regr_sxy(f, y) ** 2 / regr_sxx(f, y)) / (count(*) - 2) AS s2 FROM p GROUP BY 1),
l AS (SELECT s.*, lv AS level, 2 * s2 * ((n - 2) / 2.0) * ((1 - lv) ** (-2.0 / (n - 2)) - 1) AS d,
a * (1 - m) ** 2 + 2 * h * (1 - m) * (-q) + n * q * q AS t FROM s, (SELECT unnest([0.90, 0.95, 0.99])::DOUBLE AS lv))
SELECT l_returnflag, level, n, round(m, 6) AS slope, round(q, 4) AS intercept, round(ln(d), 4) AS log_limit, round(ln(t), 4) AS log_distance, t <= d AS unbiased FROM l""")
def ejcr_levels(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("yhat", F.expr(_FIXED))
    out = region.ejcr(df, "l_extendedprice", "yhat", (0.90, 0.95, 0.99), ["l_returnflag"])
    return out.select("l_returnflag", "level", "n", r6("slope").alias("slope"), r6("intercept", 4).alias("intercept"),
                      r6(F.ln("limit"), 4).alias("log_limit"), r6(F.ln("distance"), 4).alias("log_distance"), "unbiased")


@query("ejcr_boundary", f"""
WITH p AS (SELECT l_extendedprice AS y, {_FIXED} AS f FROM lineitem),
s AS (SELECT count(*) AS n, sum(y * y) AS a, sum(y) AS h, (regr_syy(f, y) - regr_sxy(f, y) ** 2 / regr_sxx(f, y)) / (count(*) - 2) AS s2 FROM p)
SELECT k, round(ln(2 * s2 * ((n - 2) / 2.0) * (0.05 ** (-2.0 / (n - 2)) - 1)), 4) AS log_form FROM s, (SELECT unnest(range(60)) AS k)""")
def ejcr_boundary(spark, folder):
    """Every boundary point satisfies the quadratic form of the region."""
    df = table(spark, folder, "lineitem").withColumn("yhat", F.expr(_FIXED))
    points = region.ejcr_boundary(region.ejcr(df, "l_extendedprice", "yhat", (0.95,)), 60)
    a, b = F.col("slope_at") - F.col("slope"), F.col("intercept_at") - F.col("intercept")
    form = a * a * F.col("sum_y2") + 2 * a * b * F.col("sum_y") + b * b * F.col("n")
    return points.select(F.col("k").cast("long").alias("k"), r6(F.ln(form), 4).alias("log_form"))


_NEAREST = f"""
WITH {LONG}, c AS (SELECT label AS k, pos, avg(v) AS m FROM long GROUP BY 1, 2),
d AS (SELECT vec_id, label, k, sum((v - m) ** 2) AS d FROM long JOIN c USING (pos) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, CAST(label AS VARCHAR) AS t, CAST(k AS VARCHAR) AS p FROM d
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""


@query("nearest_class_confusion", _NEAREST + """, l AS (SELECT DISTINCT CAST(label AS VARCHAR) AS k FROM embeddings)
SELECT a.k AS "true", b.k AS pred, count(p.vec_id) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.t = a.k AND p.p = b.k GROUP BY 1, 2""")
def nearest_class_confusion(spark, folder):
    pred = nearest_centroid(spectra(spark, folder).df, "label", WIDTH)
    return metrics.confusion(pred, "label", "pred")


@query("class_metrics", _NEAREST + """, u AS (SELECT t AS k FROM p UNION SELECT p FROM p),
s AS (SELECT k, count(*) FILTER (t = k AND p = k) AS hit, count(*) FILTER (t = k) AS sup, count(*) FILTER (p = k) AS called
FROM u, p GROUP BY k),
r AS (SELECT CASE WHEN called > 0 THEN hit / called ELSE 0 END AS pr, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS re, hit, sup FROM s)
SELECT round(sum(hit) / sum(sup), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall,
round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS f1 FROM r""")
def class_metrics(spark, folder):
    pred = nearest_centroid(spectra(spark, folder).df, "label", WIDTH)
    m = metrics.class_metrics(pred, "label", "pred")
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("component_pairing", f"""
WITH {LONG}, c AS (SELECT vec_id, pos AS component, v FROM long WHERE pos < 8),
y AS (SELECT vec_id, pos - 56 AS response, v FROM long WHERE pos >= 56),
r AS (SELECT component, response, regr_slope(y.v, c.v) AS slope, regr_intercept(y.v, c.v) AS intercept,
1 - (regr_syy(y.v, c.v) - regr_sxy(y.v, c.v) ** 2 / regr_sxx(y.v, c.v)) / (regr_syy(y.v, c.v) + 1e-12) AS r2
FROM c JOIN y USING (vec_id) GROUP BY 1, 2)
SELECT component, response, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2 FROM r
QUALIFY row_number() OVER (PARTITION BY component ORDER BY r2 DESC, response) = 1""")
def component_pairing(spark, folder):
    """Eight score columns against eight responses: each component's best line."""
    df = spectra(spark, folder).df.select("ix", F.slice("x", 1, 8).alias("c"), F.slice("x", 57, 8).alias("y"))
    pairs = (df.select("ix", "y", F.posexplode("c").alias("component", "score"))
             .select("component", "score", F.posexplode("y").alias("response", "value")))
    fits = metrics.simple_ols(pairs, "value", "score", ["component", "response"])
    best = metrics.best_pairing(fits)
    return best.select(F.col("component").cast("long").alias("component"), F.col("response").cast("long").alias("response"),
                       r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("r2").alias("r2"))


# --- splits -------------------------------------------------------------------------------

@query("split_random", f"""
SELECT 'cal' AS split, CAST(floor(count(*) * 0.75) AS BIGINT) AS n FROM lineitem UNION ALL
SELECT 'val', count(*) - CAST(floor(count(*) * 0.75) AS BIGINT) FROM lineitem""")
def split_random(spark, folder):
    df, _ = _indexed(spark, folder)
    done = splits.split(Dataset(df.select("ix"), (1,)), "random", 0.75)
    return done.df.groupBy("split").agg(F.count("*").alias("n"))


_QUOTA = """
WITH c AS (SELECT o_orderpriority AS k, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1),
e AS (SELECT k, n, n * (CAST(floor(t * 0.7) AS DOUBLE) / t) AS x, CAST(floor(t * 0.7) AS BIGINT) AS want FROM c),
q AS (SELECT k, n, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, k)
  <= want - sum(CAST(floor(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS quota FROM e)"""


@query("stratified_quota", _QUOTA + " SELECT k AS o_orderpriority, n, quota FROM q")
def stratified_quota(spark, folder):
    df = table(spark, folder, "orders")
    return splits.quota_table(df, "o_orderpriority", int(df.count() * 0.7))


@query("split_stratified", _QUOTA + """ SELECT k AS o_orderpriority, 'cal' AS split, quota AS n FROM q
UNION ALL SELECT k, 'val', n - quota FROM q""")
def split_stratified(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ix"), F.array("o_orderpriority").alias("classes"))
    done = splits.split(Dataset(df, (1,)), "stratified_random", 0.7)
    return done.df.groupBy(F.get("classes", F.lit(0)).alias("o_orderpriority"), "split").agg(F.count("*").alias("n"))


_KENNARD = f"""
WITH RECURSIVE {LONG}, n AS (SELECT count(*) // 4 AS want FROM embeddings),
m AS (SELECT pos, avg(v) AS m FROM long GROUP BY pos),
s AS (SELECT vec_id, sqrt(sum((v - m) ** 2)) AS d FROM long JOIN m USING (pos) GROUP BY vec_id)
"""


@query("kennard_stone")
def kennard_stone(spark, folder):
    """A quarter of the spectra in order of selection."""
    df = spectra(spark, folder).df
    picks = splits.kennard_stone(df, df.count() // 4)
    return picks.select("round", F.col("ix").alias("vec_id"))


@query("kennard_stone_start", _KENNARD + "SELECT vec_id, round(d, 6) AS d FROM s QUALIFY row_number() OVER (ORDER BY d DESC, vec_id) = 1")
def kennard_stone_start(spark, folder):
    """The starting sample: the one farthest from the mean spectrum."""
    ds = spectra(spark, folder)
    pick = splits.kennard_stone(ds.df, 1)
    from ..functions import vectors as V
    ends = stats.column_extremes(ds.df)
    mean = V.literal(ends["s"] / ends["n"])
    d = F.sqrt(V.sum_squares(V.minus("x", mean)))
    return ds.df.join(pick.select("ix"), "ix", "left_semi").select(F.col("ix").alias("vec_id"), r6(d).alias("d"))


@query("kennard_stone_stratified")
def kennard_stone_stratified(spark, folder):
    done = splits.split(spectra(spark, folder), "stratified_kennard_stone", 0.25)
    return done.df.groupBy("label", "split").agg(F.count("*").alias("n"))


# --- local models -------------------------------------------------------------------------

_Y = "CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2:] AS DOUBLE[]) AS x"
_PAIRS = f"""
WITH s AS (SELECT vec_id, {_Y} FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS t, b.y, list_distance(a.x, b.x) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, t) AS r FROM pairs)"""


def _local(**hp):
    def run(spark, folder):
        ds = regression_spectra(spark, folder)
        done = neighbors.local_predict(ds.df, ds.df, exclude="ix", width=ds.width, responses=1, **hp)
        return done.select(F.col("ix").alias("vec_id"), r6(F.get("yhat", F.lit(0))).alias("yhat"))

    return run


query("knn_predict", _PAIRS + " SELECT vec_id, round(avg(y), 6) + 0.0 AS yhat FROM near WHERE r <= 5 GROUP BY vec_id")(_local(method="knn", k=5))
query("idw_predict", _PAIRS + """ SELECT vec_id, round(sum(y / greatest(d, 1e-12) ** 2) / sum(1 / greatest(d, 1e-12) ** 2), 6) + 0.0 AS yhat
FROM near WHERE r <= 5 GROUP BY vec_id""")(_local(method="idw", k=5, power=2.0))
query("radius_predict", _PAIRS + """ SELECT vec_id, round(coalesce(avg(y) FILTER (d <= 1.1), min(y) FILTER (r = 1)), 6) + 0.0 AS yhat
FROM near GROUP BY vec_id""")(_local(method="radius", radius=1.1))
query("kernel_predict", _PAIRS + """ SELECT vec_id, round(sum(y * exp(-0.5 * (d / 0.4) ** 2)) / sum(exp(-0.5 * (d / 0.4) ** 2)), 6) + 0.0 AS yhat
FROM pairs GROUP BY vec_id""")(_local(method="kernel", bandwidth=0.4))
query("adaptive_predict", _PAIRS + """, top AS (SELECT vec_id, 1 / (1 + min(d)) AS s FROM pairs GROUP BY vec_id),
lim AS (SELECT vec_id, max(thr) AS thr FROM top, (SELECT ((10 - k) * 0.1) ** 0.5 AS thr FROM range(1, 11) t(k)) WHERE s > thr GROUP BY vec_id)
SELECT vec_id, round(avg(y), 6) + 0.0 AS yhat FROM pairs JOIN lim USING (vec_id) WHERE 1 / (1 + d) > thr GROUP BY vec_id""")(
    _local(method="adaptive", alpha=0.5))


_DISTANCES = {
    "euclidean": "sqrt(sum((a.v - b.v) ** 2))",
    "manhattan": "sum(abs(a.v - b.v))",
    "chebyshev": "max(abs(a.v - b.v))",
    "minkowski": "sum(abs(a.v - b.v) ** 3) ** (1.0 / 3)",
    "chord": "sqrt(sum((a.v / a.n - b.v / b.n) ** 2))",
}


def _vote_sql(distance, weight):
    return f"""
WITH {LONG}, u AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS n FROM long),
d AS (SELECT a.vec_id, b.vec_id AS t, b.label, {distance} AS d FROM u a JOIN u b ON a.pos = b.pos AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 10), t) <= 7),
votes AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, sum({weight}) AS s FROM near GROUP BY 1, 2)
SELECT vec_id, label AS pred, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS p FROM votes
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1"""


def _vote(distance, weights):
    def run(spark, folder):
        ds = spectra(spark, folder)
        done = neighbors.knn_classify(ds.df, ds.df, "label", 7, distance, weights, 3.0, WIDTH, exclude="ix")
        return done.select(F.col("ix").alias("vec_id"), "pred", r6(F.get("proba", F.lit(0))["p"]).alias("p"))

    return run


for _d, _sql in _DISTANCES.items():
    query(f"knn_classify_{_d}", _vote_sql(_sql, "1"))(_vote(_d, "uniform"))
query("knn_classify_weighted", _vote_sql(_DISTANCES["euclidean"], "1 / d"))(_vote("euclidean", "distance"))
query("knn_classify_mahalanobis")(_vote("mahalanobis", "uniform"))


@query("lof_scores", f"""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT a.vec_id, b.vec_id AS t, list_distance(a.x, b.x) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, t) <= 20),
k AS (SELECT vec_id, max(d) AS k FROM near GROUP BY 1),
l AS (SELECT near.vec_id, 1 / (avg(greatest(d, k.k)) + 1e-10) AS l FROM near JOIN k ON near.t = k.vec_id GROUP BY 1)
SELECT near.vec_id, round(avg(o.l) / any_value(own.l), 6) AS lof FROM near JOIN l o ON o.vec_id = near.t
JOIN l own ON own.vec_id = near.vec_id GROUP BY near.vec_id""")
def lof_scores(spark, folder):
    fitted = neighbors.lof_fit(spectra(spark, folder).df, 20, width=WIDTH)
    return fitted.select(F.col("ix").alias("vec_id"), r6("lof").alias("lof"))
