"""Multi-observer evidence fusion on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
