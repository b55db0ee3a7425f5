from types import SimpleNamespace

import pytest

from tidemark.session import shared_dir


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder if folder else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used_everywhere():
    for master in ("local[4]", "yarn"):
        assert shared_dir(session(master, "s3a://bucket/cp/"), "x").startswith("s3a://bucket/cp/x-")


def test_only_a_local_session_may_fall_back():
    a, b = shared_dir(session("local[4]"), "x"), shared_dir(session("local[4]"), "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"), "x")
