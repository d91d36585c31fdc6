"""Document extraction and verification on Spark DataFrames."""

from pyspark import cloudpickle

import pagewright

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(pagewright)
