from __future__ import annotations

import os

import pytest

from quillstream import cluster


def test_temporary_tables_are_removed(spark):
    with cluster.temporary_tables(spark):
        outer = cluster.materialise(spark.range(3), "outer")
        with cluster.temporary_tables(spark):
            inner = cluster.materialise(spark.range(4), "inner").inputFiles()
            assert inner and all(os.path.exists(f.removeprefix("file://")) for f in inner)
        assert not any(os.path.exists(f.removeprefix("file://")) for f in inner)
        assert outer.count() == 3
        kept = outer.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in kept)
    assert cluster.materialise(spark.range(5), "stays").count() == 5


def test_files(spark, tmp_path):
    path = str(tmp_path / "a" / "b.txt")
    cluster.write_bytes(spark, path, "ñ".encode())
    assert cluster.read_text(spark, path) == "ñ" and cluster.names_in(spark, str(tmp_path / "a")) == ["b.txt"]
    cluster.remove(spark, str(tmp_path / "a"))
    assert cluster.names_in(spark, str(tmp_path / "a")) == []


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        cluster.shared_root(Session)
    Context.master = "local[2]"
    assert cluster.shared_root(Session) == "/tmp/checkpoints/quillstream"
