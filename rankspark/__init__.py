"""rankspark: document matching, ranking and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
