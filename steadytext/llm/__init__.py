"""Operators for preparing training text. Nothing else in the library imports this package.

Functions of this package are pickled by value, so that executors need no copy of the
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
