"""Analytics over large collections of ordered series, as plain Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
