"""A Spark-native analytics engine for collections of source artifacts and documents."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
