"""Move tables to and from MySQL-style dump text, and audit such moves, on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
