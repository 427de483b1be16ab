"""Keep keyed tables in step with a feed of change events, on Spark."""

import sys

from pyspark import cloudpickle

# Tasks carry the few Python functions they run, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
