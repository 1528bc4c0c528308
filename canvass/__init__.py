"""Survey profiling, target planning and augmentation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helpers of this package travel inside the task, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
