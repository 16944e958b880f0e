"""Moving-object telemetry analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with
# the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
