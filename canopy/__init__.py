"""Hierarchy analytics on Spark.

Functions that run on executors travel by value, so that a cluster needs no copy
of this package: only Python, pyarrow and what an operator imports itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
