"""The shared folder and the tables in it."""

from types import SimpleNamespace

import pytest

from tessera import storage


def session(master, folder=None):
    setting = SimpleNamespace(get=lambda *a: folder)
    return SimpleNamespace(conf=setting, sparkContext=SimpleNamespace(master=master, getConf=lambda: setting))


def test_no_local_folder_on_a_cluster():
    assert storage.shared_dir(session("spark://h:1", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("local", "local[8]", "local[*]"):
        assert storage.shared_dir(session(master)).startswith("file:///tmp/")
    for master in ("spark://h:1", "yarn", "k8s://https://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))


def test_release_goes_on_after_an_error(monkeypatch):
    gone = []

    def delete(spark, path):
        if path == "b":
            raise OSError
        gone.append(path)

    monkeypatch.setattr(storage, "_delete", delete)
    monkeypatch.setattr(storage, "_written", [(None, p) for p in "abcde"])
    storage.release(1, storage.mark() - 1)
    assert gone == ["c", "d"] and [p for _, p in storage._written] == ["a", "e"]
    storage.release()
    assert gone == ["c", "d", "a", "e"] and not storage._written


def test_tables_are_read_as_written(spark):
    rows = storage.table(spark.createDataFrame([(1, None), (None, "x")], "a int, b string"), "t")
    assert sorted(map(str, rows.collect())) == sorted(["Row(a=1, b=None)", "Row(a=None, b='x')"])
