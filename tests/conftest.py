import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from opsloss.session import build_session

    shared = tempfile.mkdtemp(prefix="opsloss-tests-")
    s = build_session("local[4]", 4, app_name="opsloss-tests",
                      extra={"spark.checkpoint.dir": os.path.join(shared, "shared"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
