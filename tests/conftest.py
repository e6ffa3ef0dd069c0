import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from chatlake.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="chatlake-test-ckpt-")
    wh = tempfile.mkdtemp(prefix="chatlake-test-wh-")
    s = get_spark("local[4]", app="chatlake-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": wh})
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
