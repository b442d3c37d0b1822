"""Evaluation analytics on Spark: score, aggregate, test and monitor trial tables."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
