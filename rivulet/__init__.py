"""A PySpark-native engine for finite, ordered data pipelines."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: what a job uses of it travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
