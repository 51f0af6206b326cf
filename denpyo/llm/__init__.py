"""Operators for preparing training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors carry their code with them, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
