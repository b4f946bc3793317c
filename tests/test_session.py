import re

import pytest

from rankforge.session import DEFAULTS, shared_dir


def test_session_defaults(spark):
    for key, value in DEFAULTS.items():
        assert spark.conf.get(key) == value


def test_shared_folder_is_the_one_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second
    assert re.fullmatch(re.escape(base) + r"/x-[0-9a-f]{32}", first)


class Context:
    def __init__(self, master, checkpoint_dir=None):
        self.master, self.dir = master, checkpoint_dir

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    """Only what ``shared_dir`` asks a session for."""

    def __init__(self, master, checkpoint_dir=None):
        self.sparkContext = Context(master, checkpoint_dir)
        self.conf = {}


def test_without_the_setting_only_a_local_master_gets_a_folder():
    local = Session("local[2]")
    path = shared_dir(local, "x")
    assert path.startswith(local.sparkContext.dir)
    assert shared_dir(local, "x").startswith(local.sparkContext.dir)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"), "x")
    assert shared_dir(Session("yarn", "hdfs://host/ck/"), "x").startswith("hdfs://host/ck/x-")
