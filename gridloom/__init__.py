"""gridloom: a PySpark-native calculator for gridded numeric data."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
