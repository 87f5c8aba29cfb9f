from types import SimpleNamespace

import pytest

from casekit.session import checkpoint_dir


def fake(master, folder=None):
    """A session's parts that checkpoint_dir looks at."""
    set_to, conf = [folder], {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_to[0], setCheckpointDir=lambda p: set_to.__setitem__(0, p))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=conf.get, set=conf.__setitem__))


def test_no_folder_on_a_cluster_is_an_error(tmp_path):
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(fake(master))
        assert checkpoint_dir(fake(master, "hdfs://ns/ckpt")) == "hdfs://ns/ckpt"
        assert checkpoint_dir(fake(master), str(tmp_path / "given")) == str(tmp_path / "given")
    assert checkpoint_dir(fake("local[4]"))
