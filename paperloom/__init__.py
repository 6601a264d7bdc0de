"""paperloom: document-recognition analytics as PySpark expressions, joins, windows and streams."""

import sys

from pyspark import cloudpickle

# Python workers get the library's functions by value: they need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
