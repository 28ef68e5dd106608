"""A PySpark-native engine for multiple sequence alignment and sequence tables."""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors by value, so a cluster need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
