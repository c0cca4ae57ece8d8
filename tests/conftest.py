import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gradewell.session import local_session

    s = local_session(cores=8, shuffle_partitions=8)
    yield s


def one(spark, expr, value, schema="x string"):
    """Evaluate a column expression over a one-row frame."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("r")).first()["r"]
