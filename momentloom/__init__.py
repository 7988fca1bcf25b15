"""Clip selection over large collections of timed recordings, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors inside the jobs that use them, so a cluster
# needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
