"""Operators of a training-data pipeline: filtering, scoring, packing, search, deduplication, extraction, formatting.

Nothing else in the package imports this subpackage. Functions that run on executors are pickled by value,
so a worker needs the public libraries only and not this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
