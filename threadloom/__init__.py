"""threadloom: conversation-archive analytics and training-data operators on Spark.

Functions that run in Python workers are pickled by value, so a cluster needs
no copy of this package on its executors.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
