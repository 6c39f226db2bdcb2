"""Saving and loading of fitted models, methods and data.

Numbers go to Parquet (one row per array), the rest to a JSON text beside it; MLlib models use
their own format in a subfolder. Everything is written through Spark, so any shared file system
works.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession

from ..dataset import Axis, Dataset

_ARRAYS = "id int, shape array<int>, values array<double>, whole boolean"


def save_model(spark: SparkSession, model, path: str, method: dict | None = None) -> None:
    """Write a fitted model (any model of this library that holds no DataFrame)."""
    arrays: list = []
    learners: list = []
    tree = _pack(model, arrays, learners)
    spark.createDataFrame(arrays or [(-1, [], [], False)], _ARRAYS).write.mode("overwrite").parquet(f"{path}/arrays")
    for i, learner in enumerate(learners):
        learner.write().overwrite().save(f"{path}/learner-{i}")
    _write_json(spark, {"model": tree, "method": method or {}}, f"{path}/model")


def load_model(spark: SparkSession, path: str):
    text = _read_json(spark, f"{path}/model")
    arrays = {r["id"]: _array(r) for r in spark.read.schema(_ARRAYS).parquet(f"{path}/arrays").filter("id >= 0").collect()}
    return _unpack(text["model"], arrays, path)


def load_method(spark: SparkSession, path: str) -> dict:
    return _read_json(spark, f"{path}/model")["method"]


def save_method(spark: SparkSession, method: dict, path: str) -> None:
    """Method-only variant: the steps and their parameters without fitted numbers."""
    _write_json(spark, {"model": None, "method": method}, f"{path}/model")


def save_data(ds: Dataset, path: str) -> None:
    ds.df.write.mode("overwrite").parquet(f"{path}/samples")
    _write_json(ds.df.sparkSession, {
        "shape": list(ds.shape), "y_names": list(ds.y_names), "scaled": ds.scaled,
        "axes": [[a.numbers, a.texts, a.nature, a.name] for a in ds.axes]}, f"{path}/dataset")


def load_data(spark: SparkSession, path: str) -> Dataset:
    facts = _read_json(spark, f"{path}/dataset")
    axes = tuple(Axis(None if n is None else tuple(n), None if t is None else tuple(t), nature, name)
                 for n, t, nature, name in facts["axes"])
    return Dataset(spark.read.parquet(f"{path}/samples"), tuple(facts["shape"]), axes, tuple(facts["y_names"]), facts["scaled"])


def _write_json(spark, tree, path) -> None:
    text = json.dumps(tree)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark, path):
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def _array(r) -> np.ndarray:
    a = np.asarray(r["values"], dtype=float).reshape(r["shape"])
    return a.astype(int) if r["whole"] else a


def _pack(value, arrays, learners):
    if isinstance(value, np.ndarray):
        arrays.append((len(arrays), [int(s) for s in value.shape], [float(v) for v in value.ravel()],
                       bool(np.issubdtype(value.dtype, np.integer))))
        return {"array": len(arrays) - 1}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, DataFrame):
        raise TypeError("this model refers to its training table: save the data and refit instead")
    if isinstance(value, MLWritable):
        learners.append(value)
        kind = type(value)
        return {"learner": len(learners) - 1, "module": kind.__module__, "class": kind.__name__}
    if is_dataclass(value):
        return {"module": type(value).__module__, "class": type(value).__name__,
                "fields": {f.name: _pack(getattr(value, f.name), arrays, learners) for f in fields(value)}}
    if isinstance(value, dict):
        return {"items": [[_pack(k, arrays, learners), _pack(v, arrays, learners)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {"list": [_pack(v, arrays, learners) for v in value], "tuple": isinstance(value, tuple)}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"cannot save a {type(value).__name__}")


def _unpack(tree, arrays, path):
    if not isinstance(tree, dict):
        return tree
    if "array" in tree:
        return arrays[tree["array"]]
    if "items" in tree:
        return {_unpack(k, arrays, path): _unpack(v, arrays, path) for k, v in tree["items"]}
    if "list" in tree:
        out = [_unpack(v, arrays, path) for v in tree["list"]]
        return tuple(out) if tree["tuple"] else out
    own = __name__.split(".")[0]
    allowed = "pyspark.ml" if "learner" in tree else own
    if not (tree["module"] == allowed or tree["module"].startswith(allowed + ".")):
        raise ValueError(f"model file names a class outside {allowed}")
    kind = getattr(importlib.import_module(tree["module"]), tree["class"])
    if "learner" in tree:
        return kind.load(f"{path}/learner-{tree['learner']}")
    return kind(**{k: _unpack(v, arrays, path) for k, v in tree["fields"].items()})
