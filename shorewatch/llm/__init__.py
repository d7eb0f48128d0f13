"""Operators for preparing training corpora: deduplication, packing, mixing, search, archives.

Functions that run in tasks travel with their code, so executors need no copy of this package.
"""

import sys

from pyspark.cloudpickle import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
