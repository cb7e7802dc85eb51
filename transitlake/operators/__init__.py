"""Operators on tables. Functions that run inside tasks travel to the workers by value, so
that executors need no copy of the library on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
