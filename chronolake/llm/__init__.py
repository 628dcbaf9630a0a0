"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions that run on executors are pickled by value, so a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
