import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkprep.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="sparkprep-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy(spark):
    rows = [
        (39, " State-gov", "Bachelors", 40, "<=50K"),
        (50, " Self-emp-not-inc", "Bachelors", 13, "<=50K"),
        (None, " Private", "HS-grad", 40, "<=50K"),
        (53, " Private", "11th", 40, "<=50K"),
        (28, " Private", "Bachelors", 40, ">50K"),
        (37, " Private", "Masters", 60, ">50K"),
    ]
    return spark.createDataFrame(rows, "age bigint, workclass string, education string, hours_per_week bigint, income string")
