import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomtext.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from loomtext.suite import Tables

    return Tables(spark, os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001")
