"""Functions for Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Let Python workers receive the functions of module `name` by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
