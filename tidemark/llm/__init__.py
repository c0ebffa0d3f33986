"""Operators that a large training-data pipeline needs.

Nothing else in the library imports this subpackage.  Functions of it that run in
executors travel with the task, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
