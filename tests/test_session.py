"""Shared-folder rules and cluster sizing."""

import pytest

from tractus.session import checkpoint_base, recommended_conf


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return _Conf()


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_base(_Session("yarn"))


def test_shared_folder_is_read_from_the_session(spark):
    assert checkpoint_base(spark) == spark.sparkContext.getCheckpointDir()


def test_recommended_conf_sizes_partitions():
    small = recommended_conf(10 * 2**30, 64)
    assert small["spark.sql.shuffle.partitions"] == str(3 * 64)
    big = recommended_conf(100 * 2**40, 8000)
    assert big["spark.sql.shuffle.partitions"] == str(100 * 2**40 // (128 << 20))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
