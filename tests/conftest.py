import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lakeaudit.session import get_spark

    s = get_spark("local[4]", 8)
    # small salt so that salted joins are exercised but cheap in tests
    s.conf.set("spark.lakeaudit.saltBuckets", "4")
    # low threshold so that the hot-key path of skew-aware joins runs in tests
    s.conf.set("spark.lakeaudit.hotKeyRows", "1000")
    yield s
    s.stop()
