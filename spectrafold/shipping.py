"""Sending the package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # addPyFile uploads from the driver to every executor
    target = os.path.join(tempfile.mkdtemp(prefix="spectrafold-"), "spectrafold.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
