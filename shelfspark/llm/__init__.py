"""Corpus operators for training-data pipelines (``queries.QUERIES`` registers them).

Functions of this package that run in Python workers are shipped by value, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
