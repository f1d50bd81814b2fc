"""What a cluster needs: functions that travel, and the shared folder it names."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle

from matchloom.config import MatchConfig
from matchloom.operators import blocks, capped, shared


def test_task_functions_need_no_package_on_executors(tmp_path):
    for function in (blocks.cell_scorer(MatchConfig(), 1.0, 3), capped._cell(10)):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        code = ("import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); "
                "assert callable(f) and 'matchloom' not in sys.modules")
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function),
                       cwd=tmp_path, env=env, check=True)


def test_shared_folder_is_the_one_the_cluster_names():
    settings = {"spark.checkpoint.dir": "hdfs://shared/check/"}
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)), sparkContext=context)
    assert shared.shared_folder(session) == "hdfs://shared/check"
    assert shared.new_folder(session, "x").startswith("hdfs://shared/check/matchloom/x-")
    settings.clear()
    for context.master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_folder(session)
    context.getCheckpointDir = lambda: "hdfs://chosen/1"
    assert shared.shared_folder(session) == "hdfs://chosen/1"
    context.master, context.getCheckpointDir = "local[2]", lambda: None
    assert os.path.isdir(shared.shared_folder(session))


def test_intermediates_go_when_the_result_is_stored(spark):
    with shared.temporary(spark):
        kept = shared.materialize(spark.range(3), "x")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
