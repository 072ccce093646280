"""lobspark: order-book and tick analytics on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Worker functions travel by value, so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
