"""Operators for preparing language-model training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
