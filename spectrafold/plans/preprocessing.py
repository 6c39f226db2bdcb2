"""Queries of the preprocessing, selection and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import Axis, Dataset
from ..functions import vectors as V
from ..operators import ordering, preprocess, selection, stats
from .registry import LONG, WIDTH, lines, long_x, query, r6, spectra, table

_LINE_COLUMNS = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


# eight digits: a mean of two-decimal numbers can end in a 5 at the seventh
def _scale_sql(stat_sql, value_sql) -> str:
    parts = ", ".join(f"{stat_sql(c)}" for c in _LINE_COLUMNS.values())
    out = ", ".join(f"round({value_sql(c)}, 8) + 0.0 AS {n}" for n, c in _LINE_COLUMNS.items())
    return (f"WITH s AS (SELECT {parts} FROM lineitem) "
            f"SELECT l_orderkey, l_linenumber, {out} FROM lineitem, s")


_SCALES = {
    "scale_center": ("center", lambda c: f"avg({c}) AS m_{c}", lambda c: f"{c} - m_{c}"),
    "scale_autoscale": ("autoscale", lambda c: f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}",
                        lambda c: f"({c} - m_{c}) / (s_{c} + 1e-10)"),
    "scale_variance": ("variance", lambda c: f"avg({c}) AS m_{c}, var_pop({c}) AS s_{c}",
                       lambda c: f"({c} - m_{c}) / (s_{c} + 1e-10)"),
    "scale_robust": ("robust", lambda c: (f"quantile_cont({c}, 0.5) AS m_{c}, "
                                          f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"),
                     lambda c: f"({c} - m_{c}) / (s_{c} + 1e-10)"),
    "scale_range01": ("range_0_1", lambda c: f"min({c}) AS m_{c}, max({c}) - min({c}) AS s_{c}",
                      lambda c: f"({c} - m_{c}) / (s_{c} + 1e-10)"),
    "scale_range11": ("range_-1_1", lambda c: f"min({c}) AS m_{c}, max({c}) - min({c}) AS s_{c}",
                      lambda c: f"2.0 * ({c} - m_{c}) / (s_{c} + 1e-10) - 1.0"),
    "scale_frobenius": ("frobenius", lambda c: f"sum({c} * {c}) AS q_{c}",
                        lambda c: f"{c} / (sqrt(q_l_quantity + q_l_discount + q_l_tax) + 1e-10)"),
}


def _scale_query(method):
    def run(spark, folder):
        ds, _ = preprocess.scale(lines(spark, folder), method)
        return ds.df.select("l_orderkey", "l_linenumber",
                            *[r6(F.get("x", F.lit(i)), 8).alias(n) for i, n in enumerate(_LINE_COLUMNS)])

    return run


for _name, (_method, _stat, _value) in _SCALES.items():
    query(_name, _scale_sql(_stat, _value))(_scale_query(_method))


@query("snv_rows", f"""
WITH {LONG} SELECT vec_id, pos, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10), 6) + 0.0 AS value
FROM long WINDOW w AS (PARTITION BY vec_id)""")
def snv_rows(spark, folder):
    return long_x(preprocess.snv(spectra(spark, folder)).df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("msc_rows", f"""
WITH {LONG}, ref AS (SELECT pos, avg(v) AS r FROM long GROUP BY pos),
fit AS (SELECT vec_id, regr_slope(v, r) AS b, regr_intercept(v, r) AS a FROM long JOIN ref USING (pos) GROUP BY vec_id)
SELECT vec_id, pos, round(CASE WHEN abs(b) >= 1e-12 THEN (v - a) / b ELSE v END, 4) + 0.0 AS value
FROM long JOIN fit USING (vec_id)""")
def msc_rows(spark, folder):
    done = preprocess.msc(spectra(spark, folder)).df.withColumnRenamed("ix", "vec_id")
    return (done.select("vec_id", F.posexplode_outer("x").alias("pos", "_v"))
            .select("vec_id", F.col("pos").cast("long").alias("pos"), r6("_v", 4).alias("value")))


@query("derivative_1", f"""
WITH {LONG}, d AS (SELECT vec_id, pos - 1 AS pos, v - lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS d FROM long)
SELECT vec_id, pos, round(d, 6) + 0.0 AS value FROM d WHERE d IS NOT NULL""")
def derivative_1(spark, folder):
    return long_x(preprocess.derivative(spectra(spark, folder)).df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("derivative_2", f"""
WITH {LONG}, d AS (SELECT vec_id, pos - 2 AS pos, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d
FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY pos))
SELECT vec_id, pos, round(d, 6) + 0.0 AS value FROM d WHERE d IS NOT NULL""")
def derivative_2(spark, folder):
    return long_x(preprocess.derivative(spectra(spark, folder), 2).df.withColumnRenamed("ix", "vec_id"), "vec_id")


_CLAMPED = f"""
WITH {LONG}, o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o),
ma AS (SELECT a.vec_id, a.pos, avg(b.v) AS m FROM long a CROSS JOIN o
JOIN long b ON b.vec_id = a.vec_id AND b.pos = greatest(0, least({WIDTH - 1}, a.pos + o.o)) GROUP BY a.vec_id, a.pos)"""


@query("moving_average_5", _CLAMPED + " SELECT vec_id, pos, round(m, 6) + 0.0 AS value FROM ma")
def moving_average_5(spark, folder):
    return long_x(preprocess.smooth(spectra(spark, folder)).df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("baseline_ma_5", _CLAMPED + " SELECT vec_id, pos, round(v - m, 6) + 0.0 AS value FROM ma JOIN long USING (vec_id, pos)")
def baseline_ma_5(spark, folder):
    ds = preprocess.baseline(spectra(spark, folder), "moving_average")
    return long_x(ds.df.withColumnRenamed("ix", "vec_id"), "vec_id")


# least-squares quadratic over five points: interior weights, then the two first and two last rows
_SAVGOL = {
    "inner": (-3, 12, 17, 12, -3),
    0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5), WIDTH - 2: (-5, 6, 12, 13, 9), WIDTH - 1: (3, -5, -3, 9, 31),
}


def _savgol_sql() -> str:
    start = f"least(greatest(a.pos - 2, 0), {WIDTH - 5})"
    rows = " ".join(
        f"WHEN a.pos = {p} THEN [{', '.join(str(c) for c in w)}][b.pos - {start} + 1]"
        for p, w in _SAVGOL.items() if p != "inner")
    inner = f"[{', '.join(str(c) for c in _SAVGOL['inner'])}][b.pos - {start} + 1]"
    return (f"WITH {LONG} SELECT a.vec_id, a.pos, round(sum(b.v * CASE {rows} ELSE {inner} END) / 35.0, 6) + 0.0 AS value "
            f"FROM long a JOIN long b ON a.vec_id = b.vec_id AND b.pos BETWEEN {start} AND {start} + 4 "
            "GROUP BY a.vec_id, a.pos")


@query("savgol_5_2", _savgol_sql())
def savgol_5_2(spark, folder):
    ds = preprocess.smooth(spectra(spark, folder), "savitzky_golay", 5, 2)
    return long_x(ds.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("blank_subtract", f"""
WITH {LONG}, blank AS (SELECT pos, avg(v) AS b FROM long WHERE label = 0 GROUP BY pos)
SELECT vec_id, pos, round(v - b, 6) + 0.0 AS value FROM long JOIN blank USING (pos)""")
def blank_subtract(spark, folder):
    ds = spectra(spark, folder)
    done = preprocess.subtract_blank(ds, ds.with_df(ds.df.filter("label = '0'")))
    return long_x(done.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("nan_mean_center", f"""
WITH {LONG}, kept AS (SELECT vec_id, pos, CASE WHEN v >= 0 THEN v END AS v FROM long),
m AS (SELECT pos, avg(v) AS m FROM kept GROUP BY pos)
SELECT vec_id, pos, round(v - m, 6) + 0.0 AS value FROM kept JOIN m USING (pos) WHERE v IS NOT NULL""")
def nan_mean_center(spark, folder):
    ds = spectra(spark, folder)
    holed = ds.with_x(F.transform("x", lambda v: F.when(v >= 0, v).otherwise(float("nan"))))
    means = stats.nan_means(holed.df)
    long = stats.to_long(holed.df)
    return (long.join(F.broadcast(means), "pos").filter(~F.isnan("value"))  # one row per variable
            .select(F.col("ix").alias("vec_id"), F.col("pos").cast("long").alias("pos"),
                    r6(F.col("value") - F.col("mean")).alias("value")))


@query("tensor_snv_rows", f"""
WITH {LONG} SELECT vec_id, pos, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10), 6) + 0.0 AS value
FROM long WINDOW w AS (PARTITION BY vec_id, pos % 8)""")
def tensor_snv_rows(spark, folder):
    """SNV along the first way of 8 × 8 samples."""
    done = preprocess.snv(spectra(spark, folder, (8, 8)), way=1)
    return long_x(done.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("mode_center", f"""
WITH {LONG}, own AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM long),
slab AS (SELECT pos // 8 AS slab, avg(v) AS m FROM own GROUP BY 1)
SELECT vec_id, pos, round(v - m, 6) + 0.0 AS value FROM own JOIN slab ON slab.slab = pos // 8""")
def mode_center(spark, folder):
    """Centre the sample mode and then the first instrument mode of 8 × 8 samples."""
    ds = spectra(spark, folder, (8, 8))
    model = preprocess.fit_modes(ds, center=(0, 1))
    return long_x(model.transform(ds.df).withColumnRenamed("ix", "vec_id"), "vec_id")


@query("sfm2eem", f"""
WITH {LONG}, cell AS (SELECT vec_id, pos // 8 AS i, pos % 8 AS j, v FROM long),
placed AS (SELECT vec_id, i, i % 2 + 2 * j + 6 * (i // 2) AS c, v FROM cell),
ranked AS (SELECT vec_id, i, v, (SELECT count(*) FROM range(34) t(o)
  WHERE 3 * (o % 2) + 2 * (o // 2) < 3 * (c % 2) + 2 * (c // 2)
     OR (3 * (o % 2) + 2 * (o // 2) = 3 * (c % 2) + 2 * (c // 2) AND o < c)) AS c FROM placed)
SELECT vec_id, i * 34 + c AS pos, round(v, 6) + 0.0 AS value FROM ranked""")
def sfm2eem(spark, folder):
    """Offset step 2, excitation step 3: 8 × 8 synchronous matrices to 8 × 34."""
    done = preprocess.sfm_to_eem(spectra(spark, folder, (8, 8)), 2, 3)
    return long_x(done.df.withColumnRenamed("ix", "vec_id"), "vec_id").filter(~F.isnan("value"))


@query("remove_samples", f"""
WITH {LONG} SELECT vec_id, pos, round(v, 6) + 0.0 AS value FROM long WHERE vec_id + 1 NOT IN (2, 5, 6, 7, 10, 15, 20)""")
def remove_samples(spark, folder):
    ds = selection.select_samples(spectra(spark, folder), "2, 5-7, 10:5:20", "drop")
    return long_x(ds.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("remove_variables", f"""
WITH {LONG} SELECT vec_id, CASE WHEN pos < 2 THEN pos ELSE pos - 7 END AS pos, round(v, 6) + 0.0 AS value
FROM long WHERE pos NOT IN (2, 3, 4, 5, 9, 11, 13)
AND NOT (pos BETWEEN 6 AND 13) UNION ALL
SELECT vec_id, CASE pos WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 10 THEN 5 ELSE 6 END AS pos, round(v, 6) + 0.0
FROM long WHERE pos IN (6, 7, 8, 10, 12)""")
def remove_variables(spark, folder):
    """Drop variables by axis value: the axis runs 1, 2, … so 3-6 and 10, 12, 14 go."""
    ds = spectra(spark, folder)
    ds = Dataset(ds.df, ds.shape, axes=(Axis(numbers=tuple(float(i + 1) for i in range(WIDTH))),))
    done = selection.select_variables(ds, {1: "3-6, 10:2:14"}, "drop")
    return long_x(done.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("tensor_slice", f"""
WITH {LONG} SELECT vec_id, pos % 8 AS pos, round(v, 6) + 0.0 AS value FROM long WHERE pos // 8 = 3""")
def tensor_slice(spark, folder):
    done = selection.tensor_slice(spectra(spark, folder, (8, 8)), {1: 3})
    return long_x(done.df.withColumnRenamed("ix", "vec_id"), "vec_id")


@query("mode_unfold", f"""
WITH {LONG} SELECT vec_id, pos % 8 AS "row", pos // 8 AS "col", round(v, 6) + 0.0 AS value FROM long""")
def mode_unfold(spark, folder):
    long = selection.mode_unfold(spectra(spark, folder, (8, 8)), 2)
    return long.select(F.col("ix").alias("vec_id"), F.col("row").cast("long").alias("row"),
                       F.col("col").cast("long").alias("col"), r6("value").alias("value"))


@query("extract_columns", f"""
WITH {LONG} SELECT vec_id, pos - (CASE WHEN pos > 2 THEN 1 ELSE 0 END) AS pos, round(v, 6) + 0.0 AS value,
round(max(CASE WHEN pos = 2 THEN v END) OVER (PARTITION BY vec_id), 6) + 0.0 AS y FROM long QUALIFY pos <> 2""")
def extract_columns(spark, folder):
    """The third column becomes the response."""
    done = selection.extract_columns(spectra(spark, folder), y=3)
    out = long_x(done.df.withColumnRenamed("ix", "vec_id").withColumn("_y", F.get("y", F.lit(0))), "vec_id", "_y")
    return out.select("vec_id", "pos", "value", r6("_y").alias("y"))


@query("reindex_samples", f"""
WITH {LONG}, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_ix
FROM embeddings WHERE vec_id + 1 NOT IN (1, 2, 3))
SELECT new_ix, pos, round(v, 6) + 0.0 AS value FROM long JOIN r USING (vec_id)""")
def reindex_samples(spark, folder):
    ds = selection.reindex(selection.select_samples(spectra(spark, folder), "1-3", "drop"))
    return long_x(ds.df.withColumnRenamed("ix", "new_ix"), "new_ix")


@query("variable_stats", f"""
WITH {LONG} SELECT pos, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std,
round(min(v), 6) + 0.0 AS low, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.5), 6) + 0.0 AS median,
round(quantile_cont(v, 0.75), 6) + 0.0 AS q75, round(max(v), 6) + 0.0 AS high FROM long GROUP BY pos""")
def variable_stats(spark, folder):
    ds = spectra(spark, folder)
    model = preprocess.fit_scale(ds.df, "autoscale")
    ends = stats.column_extremes(ds.df)
    low, mid, high = stats.array_quantiles(ds.df, [0.25, 0.5, 0.75])
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(
        model.shift, model.divisor - 1e-10, ends["lo"], low, mid, high, ends["hi"]))]
    names = ["mean", "std", "low", "q25", "median", "q75", "high"]
    df = spark.createDataFrame(rows, "pos long, " + ", ".join(f"{n} double" for n in names))
    return df.select("pos", *[r6(n).alias(n) for n in names])


_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS \"row\", '{b}' AS \"col\", round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for a in _NUMBERS for b in _NUMBERS))
def corr_matrix(spark, folder):
    matrix = stats.correlation(table(spark, folder, "lineitem"), _NUMBERS)
    return stats.matrix_rows(spark, matrix, _NUMBERS, "r").select("row", "col", r6("r").alias("r"))


@query("cov_moments", f"""
WITH {LONG} SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.v, b.v), 8) + 0.0 AS cov
FROM long a JOIN long b USING (vec_id) GROUP BY a.pos, b.pos""")
def cov_moments(spark, folder):
    from ..operators.moments import moments
    cov = moments(spectra(spark, folder).df, "x", width=WIDTH)[""].covariance(1)
    rows = [(i, j, float(cov[i, j])) for i in range(WIDTH) for j in range(WIDTH)]
    return spark.createDataFrame(rows, "i long, j long, cov double").select("i", "j", r6("cov", 8).alias("cov"))


@query("histogram_30", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n,
round(any_value(lo) + (any_value(hi) - any_value(lo)) *
  CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) / 30, 6) + 0.0 AS low
FROM lineitem, s GROUP BY 1, lo, hi""")
def histogram_30(spark, folder):
    h = stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return h.select("bin", "n", r6("low").alias("low"))


@query("conf_ellipse", """
WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS ca, avg(l_extendedprice) AS cb, var_samp(l_quantity) AS va,
var_samp(l_extendedprice) AS vb, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY 1),
e AS (SELECT *, (va + vb) / 2 AS h, sqrt(((va - vb) / 2) ** 2 + c * c) AS r, -2 * ln(0.05) AS k FROM s)
SELECT l_returnflag, n, round(ca, 4) AS center_a, round(cb, 4) AS center_b, round(sqrt((h + r) * k), 4) AS major,
round(sqrt(greatest(h - r, 0) * k), 4) AS minor, round(degrees(atan2(2 * c, va - vb) / 2), 4) AS angle FROM e""")
def conf_ellipse(spark, folder):
    e = stats.confidence_ellipse(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return e.select("l_returnflag", "n", *[r6(c, 4).alias(c) for c in ("center_a", "center_b", "major", "minor", "angle")])


def _events(spark, folder):
    """Positions by user and time: a user with a third of the events spans many blocks."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return ordering.with_index(events, ["user_id", "ts", "event_id"])[0]


@query("trapz_area", """
WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, round(CASE WHEN count(*) = 1 THEN max(value) ELSE sum((value + prev) / 2) END, 6) + 0.0 AS area,
round(max(value), 6) + 0.0 AS peak, round(min(value), 6) + 0.0 AS low FROM p GROUP BY user_id""")
def trapz_area(spark, folder):
    w = ordering.block_window()
    blocks = ordering.halo_blocks(_events(spark, folder), before=1)
    prev = F.when(F.lag("user_id").over(w) == F.col("user_id"), F.lag("value").over(w))
    pieces = ordering.own_rows(blocks.withColumn("prev", prev))
    return pieces.groupBy("user_id").agg(
        r6(F.when(F.count("*") == 1, F.max("value")).otherwise(F.sum((F.col("value") + F.col("prev")) / 2))).alias("area"),
        r6(F.max("value")).alias("peak"), r6(F.min("value")).alias("low"))


@query("series_derivative", """
WITH p AS (SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT event_id, user_id, round(d, 6) + 0.0 AS d FROM p WHERE d IS NOT NULL""")
def series_derivative(spark, folder):
    w = ordering.block_window()
    blocks = ordering.halo_blocks(_events(spark, folder), before=1)
    d = F.when(F.lag("user_id").over(w) == F.col("user_id"), F.col("value") - F.lag("value").over(w))
    return (ordering.own_rows(blocks.withColumn("d", d)).filter("d is not null")
            .select("event_id", "user_id", r6("d").alias("d")))


@query("series_moving_average", """
WITH p AS (SELECT event_id, user_id, value, lag(value, 1) OVER w AS b1, lag(value, 2) OVER w AS b2, lead(value, 1) OVER w AS f1,
lead(value, 2) OVER w AS f2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, round((coalesce(b2, b1, value) + coalesce(b1, value) + value + coalesce(f1, value)
+ coalesce(f2, f1, value)) / 5, 6) + 0.0 AS smooth FROM p""")
def series_moving_average(spark, folder):
    """Five-point average with repeated edges along each user's events."""
    w = ordering.block_window()
    blocks = ordering.halo_blocks(_events(spark, folder), before=2, after=2)
    near = lambda fn, k: F.when(fn("user_id", k).over(w) == F.col("user_id"), fn("value", k).over(w))
    b1, b2, f1, f2 = near(F.lag, 1), near(F.lag, 2), near(F.lead, 1), near(F.lead, 2)
    v = F.col("value")
    mean = (F.coalesce(b2, b1, v) + F.coalesce(b1, v) + v + F.coalesce(f1, v) + F.coalesce(f2, f1, v)) / 5
    return ordering.own_rows(blocks.withColumn("smooth", mean)).select("event_id", "user_id", r6("smooth").alias("smooth"))


@query("series_monotone", """
WITH p AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, count(*) >= 3 AND (bool_and(coalesce(d, 0) >= 0) OR bool_and(coalesce(d, 0) <= 0)) AS monotone
FROM p GROUP BY user_id""")
def series_monotone(spark, folder):
    w = ordering.block_window()
    blocks = ordering.halo_blocks(_events(spark, folder), before=1)
    d = F.when(F.lag("user_id").over(w) == F.col("user_id"), F.col("value") - F.lag("value").over(w))
    steps = ordering.own_rows(blocks.withColumn("d", F.coalesce(d, F.lit(0.0))))
    return steps.groupBy("user_id").agg(((F.count("*") >= 3) & (F.bool_and(F.col("d") >= 0)
                                                               | F.bool_and(F.col("d") <= 0))).alias("monotone"))


@query("row_area", f"""
WITH {LONG} SELECT vec_id, round(sum(v) - (max(CASE WHEN pos = 0 THEN v END) + max(CASE WHEN pos = {WIDTH - 1} THEN v END)) / 2, 6)
+ 0.0 AS area, round(sqrt(sum(v * v)), 6) + 0.0 AS norm FROM long GROUP BY vec_id""")
def row_area(spark, folder):
    return spectra(spark, folder).df.select(
        F.col("ix").alias("vec_id"), r6(V.trapezoid("x")).alias("area"), r6(F.sqrt(V.sum_squares("x"))).alias("norm"))


@query("frobenius_norm", f"WITH {LONG} SELECT round(sqrt(sum(v * v)), 6) AS norm FROM long")
def frobenius_norm(spark, folder):
    return spectra(spark, folder).df.agg(r6(F.sqrt(F.sum(V.sum_squares("x")))).alias("norm"))


@query("looks_autoscaled", f"""
WITH {LONG}, s AS (SELECT pos, abs(avg(v)) AS m, abs(stddev_pop(v) - 1) AS d FROM long GROUP BY pos)
SELECT quantile_cont(m, 0.95) <= 0.15 AND quantile_cont(d, 0.95) <= 0.20 AS autoscaled FROM s""")
def looks_autoscaled(spark, folder):
    from ..operators.moments import moments
    flag = stats.looks_autoscaled(moments(spectra(spark, folder).df, "x", width=WIDTH)[""])
    return spark.createDataFrame([(flag,)], "autoscaled boolean")


@query("class_order", "SELECT CAST(label AS VARCHAR) AS label, min(vec_id) AS first_ix, count(*) AS n FROM embeddings GROUP BY label")
def class_order(spark, folder):
    """Classes by first appearance; one row per class."""
    return spectra(spark, folder).df.groupBy("label").agg(F.min("ix").alias("first_ix"), F.count("*").alias("n"))


@query("duplicate_keys", """
SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN o_orderpriority ELSE o_orderpriority || '__' || row_number() OVER w END AS key
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)""")
def duplicate_keys(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key"))
    return selection.suffix_duplicates(df, "key", "o_orderkey").select("o_orderkey", "key")


