"""Training-data operators: archives, deduplication, decontamination, formatting, tokenizing, search.

Functions of this subpackage travel to the executors by value, so they run where the library is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
