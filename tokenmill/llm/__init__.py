"""Operators for building training corpora. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions for the workers travel by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
