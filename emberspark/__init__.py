"""emberspark — wildfire-hazard scoring over multispectral pixel tables, on Spark.

Everything is expressed as DataFrame column expressions, joins and aggregates so
Catalyst can prune columns, push filters into the Parquet scan and fuse the
per-pixel work into one whole-stage-codegen stage.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
