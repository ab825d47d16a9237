"""PySpark-native record linkage and entity resolution.

Functions that run in Python workers travel by value, so executors need
Spark and numpy but no installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
