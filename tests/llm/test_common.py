import types

import pytest

from parley.llm import common


def session(conf, master):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=types.SimpleNamespace(master=master))


def test_shared_folder():
    assert common.shared_dir(session({"spark.checkpoint.dir": "hdfs://x/y/"}, "yarn")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://https://h"):
        with pytest.raises(ValueError):
            common.shared_dir(session({}, master))
    conf = {}
    for master in ("local", "local[8]", "local[*]"):
        assert common.shared_dir(session(conf, master)) == conf["spark.parley.scratch"]
