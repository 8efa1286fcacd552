import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from emberspark.session import build_session
    extra = {}
    # Tests set their own checkpoint folder only when the environment names none.
    from pyspark import SparkConf
    if not SparkConf().get("spark.checkpoint.dir", None):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="emberspark-test-ckpt-")
    s = build_session("local[4]", app="emberspark-tests", shuffle_partitions=8, extra=extra)
    yield s
    s.stop()


@pytest.fixture
def tmp_out():
    return tempfile.mkdtemp(prefix="emberspark-test-")
