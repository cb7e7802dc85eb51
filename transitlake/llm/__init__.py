"""Operators for preparing training text. Nothing else in the library imports this
package; its functions travel to the workers by value, so that executors need no
copy of it on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
