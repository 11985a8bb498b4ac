"""Search, lakehouse and anomaly analytics over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
