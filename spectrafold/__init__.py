"""Spectral and multivariate calibration analytics on Spark DataFrames."""

from .blas import single_threaded

single_threaded()

from .dataset import Axis, Dataset, dataset  # noqa: E402
from .session import build_session, durable  # noqa: E402

__all__ = ["Axis", "Dataset", "dataset", "build_session", "durable"]
