"""Operators that prepare corpora for language models.

Functions of this subpackage travel to executors by value, so that a cluster needs
neither this library on its workers nor a zip file of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
