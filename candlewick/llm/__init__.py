"""Training-data operators: each module is one operator, ``queries`` registers them.

Python functions of this package that run inside Spark tasks are shipped by value, so
executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
