import os
from types import SimpleNamespace

import pytest

from lodeline import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_clusters_folder_is_used():
    assert session.shared_dir(fake("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_dir(fake("local[2]", "/data/shared")) == "/data/shared"


def test_only_a_local_session_makes_its_own_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))
    own = session.shared_dir(fake("local[2]"))
    assert own == session.shared_dir(fake("local[2]"))


def test_written_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = session.written_once(spark, "five", build)
    b = session.written_once(spark, "five", build)
    assert len(calls) == 1 and a.count() == b.count() == 5 and a.inputFiles() == b.inputFiles()


def test_other_sessions_find_what_was_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    path, calls = str(tmp_path / "input"), []
    spark.range(5).write.parquet(path)

    def ask(label="five", new_session=True):
        if new_session:
            monkeypatch.setattr(session, "_written", {})
        source = spark.read.parquet(path)
        return session.written_once(spark, label, lambda: calls.append(1) or source.withColumn("x", source.id * 2), [source])

    first = ask()
    assert ask().inputFiles() == first.inputFiles() and ask(new_session=False).count() == 5 and len(calls) == 1
    assert ask("other").inputFiles() != first.inputFiles() and len(calls) == 2
    spark.range(9).write.mode("overwrite").parquet(path)  # changed input misses
    assert ask().count() == 9 and len(calls) == 3
    spark.read.parquet(path).limit(1).collect()
    import shutil

    found = ask()
    shutil.rmtree(os.path.dirname(found.inputFiles()[0].removeprefix("file://")))  # what the manifest names is gone
    assert ask().count() == 9 and len(calls) == 4
    assert ask().count() == 9 and len(calls) == 4


def test_a_failed_build_leaves_nothing_to_find(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    monkeypatch.setattr(session, "_written", {})
    spark.range(5).write.parquet(str(tmp_path / "input"))
    source = spark.read.parquet(str(tmp_path / "input"))
    with pytest.raises(Exception):
        session.written_once(spark, "five", lambda: source.selectExpr("raise_error('no') AS x"), [source])
    assert session.written_once(spark, "five", lambda: source, [source]).count() == 5


def test_task_count(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.task_count(spark, 1, 10) == cores and session.task_count(spark, 10_000, 10) == 1000


def test_task_functions_need_no_package_on_the_workers(tmp_path):
    """A worker that cannot import the package still loads and runs what is sent to it."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lodeline.operators import align, folds, knn, refcurve, savgol, wavelet

    sent = [knn.nearest_points, knn.cells_in_reach, refcurve.best_windows, savgol.apply_setting, folds._turn,
            align.cost_tiles, align.beam_run, align.beam_path]
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((wavelet.trailing_features, sent)))
    code = (
        "import pickle, sys, numpy as np\n"
        "f, sent = pickle.load(open('f.pkl', 'rb'))\n"
        "a, e = f(np.arange(40.0), np.arange(40), 32, 16)\n"
        "assert len(a) == 40 and not any(m.startswith('lodeline') for m in sys.modules)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=60)
