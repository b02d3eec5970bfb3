import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from rollcall.session import SESSION_DEFAULTS, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[4]").appName("rollcall-tests")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    wh = tempfile.mkdtemp(prefix="rollcall-wh-", dir="/tmp")
    b = b.config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", wh)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="rollcall-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="rollcall-test-", dir="/tmp")
