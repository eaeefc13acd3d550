"""Record matching on Spark: ingest, dedupe, scoring and ranked feeds over DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
