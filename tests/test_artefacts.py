"""Artefacts are written once; what a broken run left is no output."""

import pytest

from kinetable.sources import artefacts as A


def table(spark, sessions, value):
    return spark.createDataFrame([(s, k, value) for s in sessions for k in range(3)], "session_id long, frame_idx long, v string")


def content(spark, path):
    return sorted((r.session_id, r.v) for r in A.read_artefacts(spark, path).groupBy("session_id", "v").count().where("count = 3").collect())


def test_skip_and_refuse(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        A.read_artefacts(spark, path)
    assert A.write_artefacts(table(spark, [1, 2], "a"), path) == 2
    with pytest.raises(FileExistsError):
        A.write_artefacts(table(spark, [2, 3], "b"), path)
    assert content(spark, path) == [(1, "a"), (2, "a")]
    assert A.write_artefacts(table(spark, [2, 3], "b"), path, existing="skip") == 1
    assert A.write_artefacts(table(spark, [1, 3], "c"), path, existing="skip") == 0
    assert content(spark, path) == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        A.write_artefacts(table(spark, [4], "d"), path, existing="overwrite")


def test_a_broken_run_leaves_no_output(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    A.write_artefacts(table(spark, [1], "a"), path)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(A.scratch, "written", broken)
        with pytest.raises(RuntimeError):
            A.write_artefacts(table(spark, [2, 3], "broken"), path)
    assert content(spark, path) == [(1, "a")]
    assert A.write_artefacts(table(spark, [1, 2, 3], "b"), path, existing="skip") == 2
    assert content(spark, path) == [(1, "a"), (2, "b"), (3, "b")]
    assert spark.read.parquet(path).count() == 15  # with the rows that nothing names
