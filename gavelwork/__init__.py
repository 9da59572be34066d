"""Sold-listing and price-series analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel to the Python workers by value, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
