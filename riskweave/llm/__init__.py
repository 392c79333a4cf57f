"""Operators for training-text pipelines.

Functions of this subpackage that run in tasks travel by value, so executors need no copy
of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
