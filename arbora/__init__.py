"""Exact hierarchical clustering of numeric points on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the small task functions with the job, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
