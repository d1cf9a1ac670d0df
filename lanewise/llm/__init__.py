"""Operators for training-data pipelines: filters, near duplicates, mixing, archives, tokens."""

import sys

from pyspark import cloudpickle

# Tasks receive the functions of this package by value; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
