"""Training-data operators: near-duplicates, search, filters, mixing, packing."""

import sys

from pyspark import cloudpickle

# functions go to executors by value, so that they need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
