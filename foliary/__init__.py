"""Spark-native document knowledge index: ingest, index, search, navigate, answer."""

import sys

from pyspark import cloudpickle

from foliary.params import Params

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
