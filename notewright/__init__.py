"""Symbolic-music analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
