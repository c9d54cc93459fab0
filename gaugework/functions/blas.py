"""Matrix products and solves of a process in its own thread.

A worker runs beside one for each other core. If each of them starts a thread per core for its products, the threads wait for
each other far longer than they compute; so do those of the driver beside a busy JVM.
"""

from __future__ import annotations

import ctypes
import re
from functools import cache

_SET_THREADS = [f"{maker}openblas_set_num_threads{suffix}" for maker in ("scipy_", "") for suffix in ("64_", "")]


@cache
def one_thread() -> None:
    """Called before products and solves; once per process. Without the library's file, or its switch, nothing changes."""
    try:
        with open("/proc/self/maps") as maps:
            found = set(re.findall(r"/\S*openblas\S*", maps.read()))
    except OSError:
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in _SET_THREADS:
            if hasattr(library, name):
                getattr(library, name)(1)
                break
