"""Panel deviation and mean-reversion analytics as DataFrame transformations.

Functions that run in executors travel with the task, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
