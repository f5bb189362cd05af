import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import ensure_checkpoint_dir, local_session

    s = local_session("*", 8)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="module", autouse=True)
def nothing_kept_from_other_modules():
    """What earlier modules' frames keep cached doesn't count in a module that asks what is kept."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is not None:
        for rdd in list(sc._jsc.getPersistentRDDs().values()):
            rdd.unpersist()
    yield


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)


def frame(spark, rows, with_label=True):
    """rows: list of (row_id, label, [features])."""
    if with_label:
        return spark.createDataFrame(rows, "row_id bigint, label double, features array<double>")
    return spark.createDataFrame(rows, "row_id bigint, features array<double>")
