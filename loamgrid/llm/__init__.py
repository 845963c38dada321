"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions that tasks run travel with them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
