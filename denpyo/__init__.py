"""Business documents on Spark: classify, extract, map, validate, resolve and store
invoices and purchase orders as DataFrame -> DataFrame stages."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors carry their code with them, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
