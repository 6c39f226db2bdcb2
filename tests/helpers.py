import numpy as np

from spectrafold import Dataset


def samples(spark, x, y=None, label=None, split=None, shape=None, parts=4):
    """A dataset from NumPy arrays, rows spread over ``parts`` partitions."""
    rows, fields = [], ["ix long", "x array<double>"]
    if y is not None:
        y = np.asarray(y, dtype=float).reshape(len(x), -1)
        fields.append("y array<double>")
    if label is not None:
        fields.append("label string")
    if split is not None:
        fields.append("split string")
    for i, row in enumerate(np.asarray(x).reshape(len(x), -1)):
        r = [i, [float(v) for v in row]]
        if y is not None:
            r.append([float(v) for v in y[i]])
        if label is not None:
            r.append(str(label[i]))
        if split is not None:
            r.append(split[i])
        rows.append(tuple(r))
    df = spark.createDataFrame(rows, ", ".join(fields)).repartition(parts)
    width = rows[0][1].__len__()
    return Dataset(df, shape or (width,), y_names=() if y is None else tuple(f"y{i}" for i in range(y.shape[1])))


def wide(df, column, key="ix"):
    got = {r[key]: r[column] for r in df.select(key, column).collect()}
    return np.array([got[k] for k in sorted(got)])
