"""Spark-native analytics over append-only event logs.

Every operator takes and returns DataFrames and answers for all aggregates at
once; asking about one aggregate is a filter on the result.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
