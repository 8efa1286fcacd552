"""Operators of a training-data pipeline, their queries and SQL twins.

Nothing outside this package and ``corpus_pipeline.py`` imports it.  Functions
sent to executors are pickled by value, so a worker needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
