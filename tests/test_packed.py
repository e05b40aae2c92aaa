"""Compressed values, bytes that are no text, records of both formats and their rewriting."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratakv.functions import codec
from stratakv.operators import tiers, ttl
from stratakv.plans.config import StoreConfig
from stratakv.plans.engine import Engine
from stratakv.plans.maintenance import RECORDS, Schedule, Upgrade
from stratakv.sources import oplog, versions
from stratakv.sources.objects import MemoryBackend, ObjectTier

DAY1, DAY3 = "2024-01-01 00:00:00", "2024-01-03 00:00:00"
T1, T2 = datetime(2024, 1, 1, 2, 3, 4, 567890), datetime(2024, 1, 2)


def rows(spark, *kv):
    return spark.createDataFrame(list(kv), "key string, value string")


def test_values_are_stored_as_frames(spark, tmp_path):
    t = versions.PackedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    text = "long " * 1000
    for k in range(versions.BATCHES + 1):  # compaction keeps what is stored
        t.apply(upserts=spark.createDataFrame([(f"k{k}", text + str(k), T1, T1, None)], oplog.ENTRY))
    t.apply(upserts=spark.createDataFrame([("empty", "", T1, T1, None), ("null", None, T1, T1, None)], oplog.ENTRY))
    want = {f"k{k}": text + str(k) for k in range(versions.BATCHES + 1)} | {"empty": "", "null": None}
    assert {r.key: r.value for r in t.read().collect()} == want
    stored = t._fold()
    assert stored.where("value is not null").select(F.bool_and(codec.is_compressed(F.col("value")))).first()[0]
    assert stored.agg(F.sum(F.octet_length("value"))).first()[0] < stored.agg(F.sum("size")).first()[0] // 20


def test_sizes_are_read_without_values(spark, tmp_path):
    t = versions.PackedTable(spark, str(tmp_path / "t"), oplog.ENTRY)
    t.apply(upserts=spark.createDataFrame([("a", "12345", T1, T1, None)], oplog.ENTRY))
    u = tiers.usage(t.read(), 10)
    assert u.first().usage_percent == 50.0
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan and "ArrowEvalPython" not in plan


def test_any_bytes(spark, tmp_path):
    e = Engine(spark, StoreConfig(migration_batch=9), str(tmp_path))
    key, value = b"k\xff\x00", bytes(range(256))
    e.put_batch(spark.createDataFrame([(bytearray(key), bytearray(value))], "key binary, value binary"), DAY1)
    wanted = spark.createDataFrame([(bytearray(key),)], "key binary").select(F.col("key").cast("string").alias("key"))
    for tier in ("disk", "object"):
        r = e.get_batch(wanted).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "tier").first()
        assert (bytes(r.key), bytes(r.value), r.tier) == (key, value, tier)
        e.migrate(DAY3)


def test_replaced_and_removed_entries(spark, tmp_path):
    e = Engine(spark, StoreConfig(), str(tmp_path))
    e.put_batch(rows(spark, ("a", "1")).withColumn("ttl_secs", F.lit(60)), DAY1)
    r = e.put_batch(rows(spark, ("a", "2"), ("b", "3")), DAY3).where("key = 'a'").first()
    assert (r.previous, r.previous_created_at, r.previous_updated_at, r.previous_ttl_secs) == ("1", datetime(2024, 1, 1), datetime(2024, 1, 1), 60)
    gone = {r.key: (r.deleted, r.previous, r.previous_created_at) for r in e.delete_batch(rows(spark, ("a", ""), ("zz", ""))).collect()}
    assert gone == {"a": (True, "2", datetime(2024, 1, 3)), "zz": (False, None, None)}


def test_the_cache_counts_compressed_sizes(spark, tmp_path):
    e = Engine(spark, StoreConfig(), str(tmp_path))
    value = "again " * 10_000
    e.put_batch(rows(spark, ("a", value)), DAY1)
    assert e.get("a")["value"] == value
    assert e.stats()["memory_bytes"] == len(codec.packed(value.encode())) < 1_000 and e.stats()["disk_bytes"] == len(value)


def test_metadata_given_by_the_caller(spark):
    tier = ObjectTier(MemoryBackend(spark))
    df = spark.createDataFrame([("a", "1", "text/plain", "A", T2), ("b", "2", None, None, None)], "key string, value string, content_type string, original_key string, created_at timestamp_ntz")
    tier.put(df, DAY1)
    got = {r.key: (r.size_bytes, r.content_type, r.original_key, r.created_at) for r in tier.head(df.select("key")).collect()}
    assert got == {"a": (1, "text/plain", "A", T2), "b": (1, "application/octet-stream", "b", datetime(2024, 1, 1))}


LEGACY = b'{"value":[118,49],"created_at":"2024-01-01T02:03:04.567890Z","updated_at":"2024-01-02T00:00:00Z"}'


@pytest.mark.parametrize("value", [b"", b"v1", bytes(range(256)), b"\xcc" * 70_000, b"\x00" * 15, b"\xff" * 16])
@pytest.mark.parametrize("secs", [None, 5, 1 << 40])
def test_metadata_of_records(value, secs):
    raw = codec.encode_record(value, T1, T2, secs)
    assert codec.decode_metadata(raw) == codec.decode_record(raw)[1:] == (T1, T2, secs)
    as_bytes = bytes([1, 0x94, 0xC6]) + len(value).to_bytes(4) + value + raw[raw.index(b"2024-01-01T") - 1 :]
    assert codec.decode_metadata(as_bytes) == (T1, T2, secs)
    assert codec.decode_metadata(LEGACY) == (T1, T2, None)


def test_a_sweep_of_records_skips_damaged_ones(spark):
    old, cut = codec.encode_record(b"v", T1, T1, 60), codec.encode_record(b"v", T1, T1, 60)[:9]
    df = spark.createDataFrame([("a", bytearray(old)), ("b", bytearray(LEGACY)), ("c", bytearray(cut)), ("d", bytearray(b"")), ("e", None)], RECORDS)
    assert {tuple(r) for r in ttl.expired_records(df, [], DAY3).collect()} == {("a", "own")}
    assert {tuple(r) for r in ttl.expired_records(df, [("b", 60)], DAY3).collect()} == {("a", "own"), ("b", "rule")}


def test_records_are_rewritten_in_batches(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "records"), RECORDS)
    new = codec.encode_record(b"new", T1, T2, 7)
    data = {f"k{k}": LEGACY for k in range(5)} | {"k2b": b"broken", "n": new}
    t.apply(upserts=spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], RECORDS))
    s = Schedule(Engine(spark, StoreConfig(), str(tmp_path / "store")), upgrade=Upgrade(t, batch=3))
    s.last |= {"migration": 0.0}
    got = [s.tick(now, DAY1) for now in range(5)]
    assert got == [{"upgraded": 3}, {"upgraded": 2}, {"upgraded": 0}, {}, {}]  # the broken one is the first of the second batch
    after = {r.key: bytes(r.raw) for r in t.read().collect()}
    assert after == {f"k{k}": codec.encode_record(b"v1", T1, T2, None) for k in range(5)} | {"k2b": b"broken", "n": new}
    assert Upgrade(t).step() == 0
