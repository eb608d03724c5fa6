"""Operators for preparing training data: deduplication, filters, search, packing, archives.

Functions that run inside tasks are sent by value, so executors need numpy, pyarrow, xxhash and tokenizers, but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
