"""Text forensics and training-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
