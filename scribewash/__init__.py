"""scribewash: Spark-native transcript normalisation and training-data operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
