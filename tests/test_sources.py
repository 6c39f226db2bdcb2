import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import samples, wide
from spectrafold.operators import latent, mcr, preprocess, trees
from spectrafold.sources import files, models, tables, text
from spectrafold.sources.text import Format


def write(folder, name, lines):
    path = os.path.join(str(folder), name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


X = np.round(np.random.default_rng(0).normal(size=(7, 4)), 4)


@pytest.mark.parametrize("sep,name", [(",", "comma"), ("\t", "tabs"), ("  ", "spaces")])
@pytest.mark.parametrize("head,cols", [(0, 0), (2, 1)])
def test_row_files(spark, tmp_path, sep, name, head, cols):
    lines = [sep.join(["title"] * 5) for _ in range(head)]
    lines += [sep.join(["s"] * cols + [str(v) for v in row]) for row in X]
    ds = text.read_samples(spark, [write(tmp_path, "a.txt", lines), write(tmp_path, "b.txt", lines)])
    fmt = ds.info["format"]
    assert (fmt.separator, fmt.header_rows, fmt.header_columns, fmt.layout) == (name, head, cols, "x_matrix")
    assert np.allclose(wide(ds.df, "x"), np.vstack([X, X]))
    assert wide(ds.df, "label").tolist()[:2] == ["a_1", "a_2"] and wide(ds.df, "label")[-1] == "b_7"
    assert ds.df.filter("ix = 8").first()["meta"]["row_in_file"] == 2


def test_non_numeric_cells_are_missing(spark, tmp_path):
    path = write(tmp_path, "m.csv", ["1,2,3", "4,x,6", "", "7,8"])
    got = wide(text.read_samples(spark, path).df, "x")
    assert np.array_equal(np.isnan(got), [[0, 0, 0], [0, 1, 0], [0, 0, 1]])


def test_vector_files(spark, tmp_path):
    paths = [write(tmp_path, f"s{i}.csv", [f"{t},{v}" for t, v in zip(range(400, 404), row)]) for i, row in enumerate(X)]
    ds = text.read_samples(spark, paths)
    assert ds.info["format"].layout == "xy_vector" and np.allclose(wide(ds.df, "x"), X)
    assert wide(ds.df, "label").tolist() == [f"s{i}" for i in range(7)]


def test_matrix_files_are_padded_with_a_mask(spark, tmp_path):
    a, b = np.arange(6.0).reshape(2, 3), np.arange(8.0).reshape(2, 4)[::-1]
    paths = [write(tmp_path, f"t{i}.csv", [",".join(map(str, r)) for r in m]) for i, m in enumerate((a, b))]
    ds = text.read_samples(spark, paths, Format(layout="x_matrix"), ways=2)
    got = wide(ds.df, "x").reshape(2, 2, 4)
    assert ds.shape == (2, 4) and np.allclose(got[1], b) and np.allclose(got[0, :, :3], a) and np.isnan(got[0, :, 3]).all()
    assert wide(ds.df, "mask").reshape(2, 2, 4)[0, :, 3].tolist() == [False, False]


def test_xy_matrix_and_orders(spark, tmp_path):
    m = np.arange(8.0).reshape(4, 2)
    lines = [f"{i},{r[0]},{i},{r[1]}" for i, r in enumerate(m)]
    ds = text.read_samples(spark, write(tmp_path, "xy.csv", lines), ways=2)
    assert ds.info["format"].layout == "xy_matrix" and np.allclose(wide(ds.df, "x").reshape(4, 2), m)
    flat = write(tmp_path, "v.csv", [str(v) for v in range(6)])
    for order in "FC":
        got = text.read_samples(spark, flat, Format(layout="x_vector"), ways=2, dims=(2, 3), order=order)
        assert np.allclose(wide(got.df, "x").reshape(2, 3), np.arange(6.0).reshape((2, 3), order=order))


def test_several_files_per_sample(spark, tmp_path):
    t = np.random.default_rng(1).normal(size=(2, 3, 2, 2)).round(3)   # samples × 3 × 2 × 2
    paths = []
    for s in range(2):
        for f in range(4):
            i, j = np.unravel_index(f, (2, 2), order="F")
            paths.append(write(tmp_path, f"s{s}_{f}.txt", [str(v) for v in t[s, :, i, j]]))
    ds = text.read_samples(spark, paths, Format(layout="x_vector", separator="comma"), ways=3, dims=(3, 2, 2), files_per_sample=4)
    assert np.allclose(wide(ds.df, "x").reshape(t.shape), t)
    assert wide(ds.df, "label").tolist() == ["Sample_1", "Sample_2"]


def test_side_files(spark, tmp_path):
    ds = samples(spark, X[:3])
    y = text.read_responses(spark, write(tmp_path, "y.txt", ["a\tb", "1\t2", "3\t4", "5\t6"]), 3, separator="comma")
    c = text.read_classes(spark, write(tmp_path, "c.txt", ["p,q", "r", "s,t"]))
    out = text.attach(ds, y, c, text.read_labels(spark, write(tmp_path, "l.txt", ["u", "v", "w"])))
    assert wide(out.df, "y").tolist() == [[1, 2], [3, 4], [5, 6]] and out.y_names == ("Y1", "Y2")
    assert wide(out.df, "classes").tolist() == [["p", "q"], ["r", ""], ["s", "t"]]
    named, names = text.read_responses(spark, write(tmp_path, "n.csv", ["a,b", "1,2"]), names_in_file=True)
    assert names == ("a", "b") and named.first()["y"] == [1.0, 2.0]
    marks = text.read_selection(spark, write(tmp_path, "sel.txt", ["1", "2", "1"]), 3)
    assert [r["mark"] for r in marks.orderBy("ix").collect()] == [1, 2, 1]
    with pytest.raises(ValueError):
        text.read_selection(spark, write(tmp_path, "sel2.txt", ["1"]), 3)


def test_axes():
    assert text.spaced_axis(1, 100, 3, "Log10").numbers == pytest.approx((1, 10, 100))
    assert text.spaced_axis(-1, 1, 3, "Ln").numbers == pytest.approx((-1, 0, 1))


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = write(tmp_path, "long.txt", [str(i) for i in range(5000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = text.scan_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 3
        assert lines.filter(F.col("line_no") != F.col("value").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_models_come_back(spark, tmp_path):
    x = np.abs(np.random.default_rng(2).normal(size=(40, 6)))
    ds = samples(spark, x, x[:, :1])
    fitted = [preprocess.fit_scale(ds.df, "autoscale"), latent.pca(ds, 2), mcr.mcr_als(ds, 2, max_iter=3),
              trees.tree_regressor(ds.df, "random_forest", 1, 10, 3)]
    for i, model in enumerate(fitted):
        path = str(tmp_path / f"m{i}")
        models.save_model(spark, model, path, {"step": i})
        again = models.load_model(spark, path)
        old, new = (m.transform(ds.df) if hasattr(m, "transform") else m.predict(ds.df) for m in (model, again))
        column = [c for c in old.columns if c not in ("ix", "y")][0]
        assert np.allclose(wide(old, column), wide(new, column))
        assert models.load_method(spark, path) == {"step": i}
    models.save_data(ds, str(tmp_path / "d"))
    assert models.load_data(spark, str(tmp_path / "d")).shape == ds.shape


def test_output_table(spark):
    df = samples(spark, X).df
    out = tables.output_table(df, max_rows=2, max_cols=3, decimals=1)
    assert out.columns == ["ix", "x_1", "x_2"] and out.count() == 2


def test_slices_give_every_line_once(spark, tmp_path):
    from spectrafold.sources import files

    lines = [f"{i}," + "9" * (i % 37) for i in range(400)] + ["", "last"]
    path = write(tmp_path, "long.txt", lines)
    for size in (7, 64, 1000):
        rows = files.lines(spark, path, slice_bytes=size).collect()
        assert [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])] == lines
        assert len({r["line_no"] for r in rows}) == len(lines)
    assert files.lines(spark, path, slice_bytes=64).rdd.getNumPartitions() > 50
    # one scan and no job for the numbers of the lines
    plan = files.lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_files_in_the_given_order_and_by_pattern(spark, tmp_path):
    from spectrafold.sources import files

    b, a = write(tmp_path, "b.csv", ["1"]), write(tmp_path, "a.csv", ["2", "", "3"])
    assert [f.path for f in files.found([b, a])] == [b, a]
    assert [f.path for f in files.found(str(tmp_path))] == [a, b] == [f.path for f in files.found(f"{tmp_path}/*.csv")]
    ds = text.read_samples(spark, [b, f"file:{a}"], Format(layout="x_matrix", separator="comma"))
    assert wide(ds.df, "x").tolist() == [[1.0], [2.0], [3.0]]
    meta = [r["meta"] for r in ds.df.orderBy("ix").collect()]
    assert [m["sample_index"] for m in meta] == [0, 1, 2] and [m["row_in_file"] for m in meta] == [1, 1, 2] and meta[0]["created_time"]
    with pytest.raises(Exception, match="nowhere"):
        text.read_samples(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("lines,want", [(["1,2", "3,4"], [[1, 2], [3, 4]]), (["1,,2", "3"], [[1, None, 2], [3, None, None]]), (["1_0,nan"], [[None, None]]),
                                        (["1 2", "3 4 5"], [[None], [None]]), (["1e3, 2 ", "-inf,x"], [[1000, 2], [float("-inf"), None]])])
def test_matrix_of_lines(lines, want):
    from spectrafold.sources.files import matrix

    got, _ = matrix(lines, "comma")
    assert [[None if np.isnan(v) else v for v in row] for row in got] == want


def test_tensors_by_sparks_own_files(spark, tmp_path, monkeypatch):
    """The route for stores that only Spark opens gives the same samples."""
    paths = [write(tmp_path, f"t{i}.csv", ["h,h"] * 2 + [",".join(map(str, r)) for r in np.arange(6.0 * (i + 1)).reshape(-1, 3)]) for i in range(3)]
    a = text.read_samples(spark, paths, ways=2, pad=0.0)
    monkeypatch.setattr(text.source, "known", lambda paths: False)
    b = text.read_samples(spark, paths, ways=2, pad=0.0)
    assert a.shape == b.shape == (6, 3) and a.info["format"] == b.info["format"]
    for c in ("x", "mask", "label"):
        assert wide(a.df, c).tolist() == wide(b.df, c).tolist()


def test_small_files_are_spread_over_tasks(spark, tmp_path):
    """1,500 small files: written as they are named, read by several tasks; detection lists what leads to the first file."""
    rows = [(i, f"{i}\n{i + 0.5}") for i in range(1500)] + [(3, "7")]
    files.write_each(spark.createDataFrame(rows, "name int, value string").repartitionByRange(3, "name"), "name", str(tmp_path))
    assert files.first_found(str(tmp_path)) == files.found(str(tmp_path))[:1]
    whole = text.scan_files(spark, str(tmp_path))
    assert whole.rdd.getNumPartitions() == 3
    got = {r["file_path"]: r["value"] for r in whole.collect()}
    assert len(got) == 1500 and got[f"{tmp_path}/name=5/part-0.txt"] == "5\n5.5\n" and sorted(got[f"{tmp_path}/name=3/part-0.txt"].split()) == ["3", "3.5", "7"]
    spec = {"separator": "comma", "header_rows": 0, "header_columns": 0, "layout": "x_vector", "transpose": False, "dims": None, "order": "F", "files": 1}
    read = files.tensors(spark, str(tmp_path), spec)
    assert read.rdd.getNumPartitions() == 3 and read.count() == 1500


def test_first_file_in_path_order(tmp_path):
    for name in ("a/z.txt", "a-b/y.txt", "_a/x.txt", "b.txt", "a/.c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1\n")
    (tmp_path / "a-a").mkdir()
    assert files.first_found([str(tmp_path)]) == files.found([str(tmp_path)])[:1]
    assert files.first_found([str(tmp_path)])[0].path.endswith("a-b/y.txt")
