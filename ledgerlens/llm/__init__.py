"""Operators for large training corpora. Nothing else in the library imports this subpackage.

Functions that run on executors are pickled by value, so the workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
