"""Corpus and table analytics as DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, with the helpers they call: executors then
# need neither this package nor its folder on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
