"""Operators of a training-data pipeline over document tables.

Nothing else in the package imports this subpackage. Its Python functions travel to the workers
by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
