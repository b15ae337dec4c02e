"""Item-bank and learner-performance analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: the few functions that run in Python
# workers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
