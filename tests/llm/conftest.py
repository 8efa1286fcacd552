import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SCHEMA, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like those that the operators add or use inside."""
    from pyspark.sql import functions as F
    names = ["toxic_score", "offending", "quality_score", "n_hit", "spans", "shard", "slot", "sequence_id", "offset", "base_spans",
             "secret_spans", "__hex", "kept", "component_id", "token", "score", "row", "node", "key", "__text", "item_ids", "block"]
    return odd.withColumns({n: F.lit("mine") for n in names})
