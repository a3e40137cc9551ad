import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeshift.session import build_session

    s = build_session("local[4]", app_name="codeshift-tests", shuffle_partitions=8,
                      extra_conf={"spark.driver.memory": "8g"})
    # Tests run locally: a fresh checkpoint folder of their own.
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="codeshift-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
        s.conf.set("spark.checkpoint.dir", d)
    yield s
    s.stop()


@pytest.fixture
def tmpdir_spark(tmp_path):
    return str(tmp_path)
