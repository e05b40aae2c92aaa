"""What must survive restarts, repeated deliveries and jobs that stop half-way."""

from datetime import datetime

import pytest

from stratakv.plans.config import StoreConfig
from stratakv.plans.engine import Engine
from stratakv.sources import oplog, versions
from stratakv.streaming import replication

DAY1, DAY3 = "2024-01-01 00:00:00", "2024-01-03 00:00:00"


def log(spark, *ops):
    return spark.createDataFrame([(seq, datetime(2024, 1, 1), op, key, value, None, 0) for seq, op, key, value in ops], oplog.OPLOG)


def live(df):
    return {r.key: r.value for r in df.collect()}


def entries(spark, **kv):
    return spark.createDataFrame([(k, v, datetime(2024, 1, 1), datetime(2024, 1, 1), None) for k, v in kv.items()], oplog.ENTRY)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    stream = lambda: spark.readStream.schema(oplog.OPLOG).parquet(str(tmp_path / "log"))
    log(spark, (1, "put", "a", "1"), (5, "put", "b", "5")).write.parquet(str(tmp_path / "log"))
    assert live(replication.Fold(spark, str(tmp_path / "state")).run(stream())) == {"a": "1", "b": "5"}
    # an older sequence that comes late doesn't win
    log(spark, (2, "put", "c", "2"), (3, "put", "b", "3")).write.mode("append").parquet(str(tmp_path / "log"))
    assert live(replication.Fold(spark, str(tmp_path / "state")).run(stream())) == {"a": "1", "b": "5", "c": "2"}
    # a new checkpoint delivers everything again
    assert live(replication.Fold(spark, str(tmp_path / "state")).run(stream(), str(tmp_path / "other"))) == {"a": "1", "b": "5", "c": "2"}


def test_an_epoch_that_is_delivered_twice(spark, tmp_path):
    f = replication.Fold(spark, str(tmp_path))
    f.apply(log(spark, (1, "put", "a", "1")), 0)
    f.apply(log(spark, (2, "delete", "a", None), (3, "put", "b", "3")), 1)
    before = f.table.manifest()
    f.apply(log(spark, (2, "delete", "a", None), (3, "put", "b", "3")), 1)
    assert f.table.manifest() == before and live(f.state().where("op = 'put'")) == {"b": "3"}


def test_a_write_that_stops_before_its_manifest(spark, tmp_path, monkeypatch):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    t.apply(entries(spark, a="1"))

    def stop(*args, **changes):
        raise OSError("stopped")

    monkeypatch.setattr(t, "_replace", stop)
    with pytest.raises(OSError):
        t.apply(entries(spark, b="2"))
    monkeypatch.undo()
    again = versions.VersionedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    assert live(again.read()) == {"a": "1"}
    again.apply(entries(spark, c="3"))
    assert live(again.read()) == {"a": "1", "c": "3"}


def test_a_missing_manifest_is_no_empty_table(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    t.apply(entries(spark, a="1"))
    for f in (tmp_path / "t").glob("MANIFEST-*"):
        f.unlink()
    with pytest.raises(OSError, match="no manifest"):
        t.read()


def test_two_writers_of_one_version(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    t.apply(entries(spark, a="1"))
    stale = t.manifest()
    t.apply(entries(spark, b="2"))
    with pytest.raises(OSError, match="there already"):
        t._replace(stale)
    assert live(t.read()) == {"a": "1", "b": "2"}


def test_a_key_twice_in_a_batch(spark, tmp_path):
    e = Engine(spark, StoreConfig(), str(tmp_path))
    e.put_batch(spark.createDataFrame([("a", "1")], "key string, value string"), DAY1)
    with pytest.raises(ValueError, match="twice"):
        e.put_batch(spark.createDataFrame([("a", "2"), ("a", "3")], "key string, value string"), DAY1)
    assert live(e.disk.read()) == {"a": "1"}


def test_cached_keys(spark, tmp_path):
    one = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    e = Engine(spark, StoreConfig(migration_batch=1), str(tmp_path))
    e.put_batch(one("a", "old"), DAY1)
    assert e.get("a")["tier"] == "disk" and e.get("a")["tier"] == "memory"
    assert e.migrate(DAY3) == 1
    assert e.get_batch(one("a", "")).first().tier == "memory"  # it moved, but the cache still answers
    e.put_batch(one("a", "new"), DAY3)
    assert e.get("a")["value"] == "new"  # not the object that was left behind
    e.delete_batch(one("a", ""))
    assert not e.cache.contains("a") and e.get("a") is None
