"""wavestrata: archives of sampled signals as Spark tables, and tools on top."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
