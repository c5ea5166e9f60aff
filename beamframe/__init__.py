"""Spinning-lidar and point-cloud analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
