"""Text/time alignment and timeline analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that those need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
