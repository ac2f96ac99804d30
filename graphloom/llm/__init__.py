"""Training-data operators: filtering, de-duplication, tokenising, packing and search over document tables.

Nothing outside this folder imports it; ``registry.queries()`` lists its queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the tasks by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
