"""One linear-algebra thread per process.

Spark already runs one Python task per core, so threads inside a task only compete; on the
driver a thread pool that was started before a fork can stall small solves.
"""

from __future__ import annotations

import ctypes
import glob
import os

import numpy


def single_threaded() -> None:
    """Ask the OpenBLAS that NumPy brings along for one thread; other builds read the variables."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    pattern = os.path.join(os.path.dirname(numpy.__file__), os.pardir, "numpy.libs", "*openblas*")
    for path in glob.glob(pattern):
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for symbol in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads",
                       "openblas_set_num_threads"):
            setter = getattr(library, symbol, None)
            if setter is not None:
                setter(ctypes.c_int(1))
                break
