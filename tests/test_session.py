"""Shared storage, what is removed from it, and sending the package to executors."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from millrace import session

REPO = Path(__file__).resolve().parent.parent


class _Fake:
    """A session on a cluster, with a checkpoint folder or none."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):  # noqa: N802
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_has_to_name_its_folder(master):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(_Fake(master))
    assert session.shared_folder(_Fake(master, "hdfs:///shared/")) == "hdfs:///shared"


def test_local_sessions_fall_back():
    assert session.shared_folder(_Fake("local[4]")).startswith("file://")


def test_scopes_and_sweeps_remove_what_was_written(spark):
    local = lambda path: path.removeprefix("file:").replace("///", "/")
    with session.Scope(spark) as scope:
        written, cut = session.write_out(spark.range(5)), session.cut_lineage(spark.range(7))
        assert (written.count(), cut.count()) == (5, 7)
        paths = [local(p) for p in scope.paths]
        assert len(paths) == 2 and all(os.path.exists(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)
    session.sweep(spark)
    session.write_out(spark.range(1))
    assert session.sweep(spark) == 1 and session.sweep(spark) == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from millrace.session import build_session
from millrace.operators import replay
spark = build_session("elsewhere", cores=1)
feed = spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 2, 2, 1, "b")], "k int, s long, op int, bits long, v string")
print([tuple(r) for r in replay.replay_feed(feed, ["k"], "s", "op", "bits", ["v"]).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(1, 2, 'b')]" in done.stdout, done.stderr[-2000:]
