"""Registries written, read back, and written by several at once."""

import threading

import pytest
from pyspark.sql import functions as F

from listingflow import schemas
from listingflow.sources import readers, versions, writers


def entries(spark, *ids, at=1):
    return spark.createDataFrame([(str(i), f"c{i}", f"t{i}", at, None) for i in ids], schemas.REGISTRY)


def ids(df):
    return sorted((r["listingId"], r["admitTime"]) for r in df.collect())


def test_versions_are_read_back(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert versions.read_version(spark, path).count() == 0 and readers.read_registry(spark, path).count() == 0
    assert versions.commit(spark, path, entries(spark, 1, 2, 3)) == 1
    assert versions.commit(spark, path, entries(spark, 2, at=5), spark.createDataFrame([("3",), ("9",), (None,)], "listingId string")) == 2
    want = [("1", 1), ("2", 5)]
    assert ids(readers.read_registry(spark, path)) == want and ids(versions.read_version(spark, path, 1)) == [("1", 1), ("2", 1), ("3", 1)]
    assert versions.compact(spark, path) == 3 and ids(versions.read_version(spark, path)) == want
    assert versions.commit(spark, path, entries(spark, 3, at=7), spark.createDataFrame([("1",), ("3",)], "listingId string")) == 4
    assert ids(versions.read_version(spark, path)) == [("2", 5), ("3", 7)] and ids(versions.read_version(spark, path, 3)) == want and ids(versions.read_version(spark, path, 2)) == want
    assert versions.read_version(spark, path).schema == schemas.REGISTRY
    with pytest.raises(ValueError):
        versions.commit(spark, path)


def test_two_writers_and_a_crash(spark, tmp_path):
    path = str(tmp_path / "reg")
    versions.commit(spark, path, entries(spark, 0))
    entries(spark, 666).withColumn("_admits", F.lit(True)).write.parquet(f"{path}/changes-dead")  # never entered
    (tmp_path / "reg/log/.draft").write_text("{")
    got, failed = [], []

    def write(k):
        try:
            got.extend(versions.commit(spark, path, entries(spark, 10 * k + i)) for i in range(3))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(got) == list(range(2, 8)) and versions.versions(spark, path) == list(range(1, 8))
    assert {i for i, _ in ids(readers.read_registry(spark, path))} == {"0", "10", "11", "12", "20", "21", "22"}


def test_changes_during_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reg")
    versions.commit(spark, path, entries(spark, 1))
    read = versions.read_version

    def slow(*args):
        out = read(*args)
        versions.commit(spark, path, entries(spark, 2))
        return out

    monkeypatch.setattr(versions, "read_version", slow)
    assert versions.compact(spark, path) == 3
    assert [i for i, _ in ids(read(spark, path))] == ["1", "2"]


def test_snapshots_are_read_back_once_complete(spark, tmp_path):
    path = str(tmp_path / "reg")
    for v, rows in ((1, (1,)), (2, (1, 2)), (3, (1, 2, 3))):
        writers.write_registry(entries(spark, *rows), path, v)
    (tmp_path / "reg/version=00000003/_SUCCESS").unlink()  # died on the way
    assert [i for i, _ in ids(readers.read_registry(spark, path))] == ["1", "2"]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_registry(entries(spark, 5), path, 2)
