"""quire: a Spark-native engine for libraries of plain-text books."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
