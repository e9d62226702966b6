"""Operators of a training-data pipeline: deduplication, decontamination, archives, tokens, scoring."""

import sys

from pyspark import cloudpickle

# The functions that tasks run travel with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
