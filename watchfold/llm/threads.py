"""One thread for linear algebra in a task.

Spark gives a Python worker as many threads as its executor has cores, yet a task
has one of them; numpy's OpenBLAS would spin on the others' cores.  The number can
only be told to the library itself once numpy is loaded.
"""

from __future__ import annotations

import ctypes
import glob
import os
from functools import cache

import numpy as np

_NAMES = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads")


@cache
def one_thread() -> None:
    """Once a worker process; without an OpenBLAS beside numpy nothing changes."""
    for path in glob.glob(os.path.dirname(np.__file__) + ".libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in _NAMES:
            if hasattr(library, name):
                getattr(library, name)(1)
