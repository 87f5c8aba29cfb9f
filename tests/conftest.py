import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from casekit.session import checkpoint_dir, get_session
    s = get_session("local[4]", app_name="casekit-tests", shuffle_partitions=8)
    # Tests run without a cluster-provided spark.checkpoint.dir: use scratch.
    checkpoint_dir(s, tempfile.mkdtemp(prefix="casekit-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="casekit-test-")
