"""Functions that run in tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def carried(module: str) -> None:
    """Send the module's functions to the executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
