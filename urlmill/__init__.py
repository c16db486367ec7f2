"""URL analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package on their path: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
