"""Where intermediate data may go."""

from types import SimpleNamespace

import pytest

from sondage.session import checkpoint_root


def session(master, named=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None),
    )


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,3000]", "spark://host:7077", "k8s://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session(master))
    assert checkpoint_root(session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_makes_its_own():
    assert "sondage-ckpt-" in checkpoint_root(session("local[2]"))
