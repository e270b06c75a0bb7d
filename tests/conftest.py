import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import session

    s = session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
