"""Set-at-a-time recommendation analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
