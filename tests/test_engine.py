"""The engine as a whole, its routes, and the streams."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from stratakv.plans.config import StoreConfig
from stratakv.plans.engine import Engine, route_request
from stratakv.sources import oplog
from stratakv.streaming import replication

DAY1, DAY3 = "2024-01-01 00:00:00", "2024-01-03 00:00:00"


def rows(spark, *kv):
    return spark.createDataFrame(list(kv), "key string, value string")


def names(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_life_of_entries(spark, tmp_path):
    e = Engine(spark, StoreConfig(migration_batch=1, ttl_rules=[("tmp/", 3600)]), str(tmp_path))
    e.put_batch(rows(spark, ("a", "v1"), ("b", "v1"), ("tmp/x", "v1")), DAY1)
    assert {r.key: r.previous for r in e.put_batch(rows(spark, ("a", "v2")), DAY3).collect()} == {"a": "v1"}
    assert e.expire(DAY3) == 1 and e.expire(DAY3) == 0
    assert e.migrate(DAY3) == 1  # a was written anew: b is the one that is old
    got = {r.key: (r.value, r.tier) for r in e.get_batch(names(spark, "a", "b", "tmp/x")).collect()}
    assert got == {"a": ("v2", "disk"), "b": ("v1", "object"), "tmp/x": (None, None)}
    e.put_batch(rows(spark, ("b", "v9")), DAY3)
    assert e.get_batch(names(spark, "b")).first().value == "v9"  # the object is left behind, but hidden
    s = e.stats()
    assert (s["disk_entries"], s["object_entries"], s["migrations_completed"]) == (2, 1, 1)
    assert {r.key: r.deleted for r in e.delete_batch(names(spark, "b", "zz")).collect()} == {"b": True, "zz": False}
    assert e.contains_batch(names(spark, "b")).count() == 0
    # another engine on the same folder finds what was written
    assert Engine(spark, StoreConfig(), str(tmp_path)).get_batch(names(spark, "a")).first().value == "v2"


def test_routes(spark, tmp_path):
    e = Engine(spark, StoreConfig(), str(tmp_path))
    assert e.handle("GET", "/health")[0] == 200
    assert e.handle("GET", "/kv/k")[1]["code"] == "KEY_NOT_FOUND"
    assert e.handle("PUT", "/kv/k", json.dumps({"value": "myvalue", "ttl": 60}), DAY1)[0] == 201
    assert e.handle("GET", "/kv/k") == (200, {"key": "k", "value": "myvalue", "tier": "memory"})
    assert e.handle("PUT", "/kv/n", json.dumps({"value": "123"}), DAY1)[0] == 201
    assert e.handle("GET", "/kv//n")[1]["value"] == 123
    assert e.handle("HEAD", "/kv/k")[0] == 200 and e.handle("HEAD", "/kv/none")[0] == 404
    assert e.handle("PUT", "/kv/k", "{}", DAY1)[0] == e.handle("PUT", "/kv/k", '{"value": 5}', DAY1)[0] == 422
    assert e.handle("DELETE", "/kv/k") == (200, {"key": "k", "deleted": True})
    assert e.handle("DELETE", "/kv/k") == (200, {"key": "k", "deleted": False})
    assert e.handle("POST", "/admin/migrate", as_of=DAY3)[1]["migrated"] == 1
    assert e.handle("GET", "/stats")[1]["object_entries"] == 1
    assert e.handle("POST", "/admin/flush")[0] == 200 and e.handle("GET", "/nowhere")[0] == 404


def test_wrong_shard(spark, tmp_path):
    e = Engine(spark, StoreConfig(total_shards=3, shard_id=0), str(tmp_path))  # my-key belongs to shard 1
    assert e.handle("PUT", "/kv/my-key", '{"value":"v"}', DAY1)[0] == 421
    assert e.handle("GET", "/kv/my-key")[0] == e.handle("DELETE", "/kv/my-key")[0] == 404
    assert route_request("/my-key", ["a:1", "b:2", "c:3"]) == "http://b:2/kv/my-key"


def test_streamed_fold_and_cache(spark, tmp_path):
    ops = [(k, datetime(2024, 1, 1), "delete" if k % 5 == 0 else "put", f"k{k % 4}", None if k % 5 == 0 else str(k), None, 0) for k in range(1, 21)]
    df = spark.createDataFrame(ops, oplog.OPLOG)
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = replication.Fold(spark, str(tmp_path / "state")).run(stream)
    assert sorted(map(tuple, got.select("key", "value", "seq").collect())) == sorted(map(tuple, oplog.live(df).select("key", "value", "seq").collect()))
    accesses = stream.select(F.lit(0).alias("shard"), "seq", F.lit("put").alias("op"), "key", F.lit(1).cast("long").alias("size"))
    q = replication.cache_stream(accesses, 2, 10).writeStream.format("memory").queryName("cache_state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(r.entries for r in spark.table("cache_state").collect()) == 2
    q = replication.operation_counts(stream).writeStream.format("memory").queryName("op_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("op_counts").collect()) == 20


def test_schedule(spark, tmp_path):
    from stratakv.plans.maintenance import Schedule

    e = Engine(spark, StoreConfig(disk_bytes=5, ttl_rules=[("tmp/", 60)]), str(tmp_path))
    e.put_batch(rows(spark, ("a", "v" * 5), ("tmp/b", "v")), DAY1)
    s = Schedule(e)
    assert s.tick(0, DAY1) == {"migrated": 2, "expired": 0}  # full: space pressure picks entries of any age
    assert s.tick(30, DAY3) == {} and s.tick(61, DAY3) == {"migrated": 0}
    e.put_batch(rows(spark, ("tmp/c", "v")), DAY1)
    assert s.tick(301, DAY3) == {"migrated": 0, "expired": 1}


def test_segments_fold_and_compact(spark, tmp_path):
    from stratakv.sources import versions
    from stratakv.sources.oplog import ENTRY

    t = versions.VersionedTable(spark, str(tmp_path / "t"), ENTRY)
    row = lambda *kv: spark.createDataFrame([(k, v, datetime(2024, 1, 1), datetime(2024, 1, 1), None) for k, v in kv], ENTRY)
    want = {}
    t.apply(deletes=names(spark, "none"))
    assert t.read().count() == 0
    for k in range(versions.BATCHES + 3):
        put, gone = [(f"k{k}", f"v{k}"), ("same", str(k))], f"k{k - 2}"
        t.apply(row(*put), names(spark, gone, "same"))
        want |= dict(put)
        want.pop(gone, None)
        assert {r.key: r.value for r in t.read().collect()} == want
    m = t.manifest()
    assert len(m["segments"]) < versions.BATCHES and m["next"] > versions.BATCHES
    before = t.read()
    t.compact()
    assert before.count() == t.read().count() == len(want)  # segments that a reader opened are still there


def test_sockets(spark, tmp_path):
    import urllib.error
    import urllib.request
    from threading import Thread

    from stratakv.plans.server import engine_server, router_server

    def call(port, method, path, body=None):
        try:
            r = urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, method=method), timeout=60)
            return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    shard = engine_server(Engine(spark, StoreConfig(), str(tmp_path)), clock=lambda: DAY1)
    router = router_server([f"127.0.0.1:{shard.server_port}"], timeout=60)
    dead = router_server(["127.0.0.1:9"], timeout=1)
    servers = [shard, router, dead]
    for s in servers:
        Thread(target=s.serve_forever, daemon=True).start()
    try:
        assert call(router.server_port, "GET", "/health") == (200, "ok")
        assert call(router.server_port, "PUT", "/kv/k", b'{"value": "1"}')[0] == 201
        assert json.loads(call(shard.server_port, "GET", "/kv/k")[1]) == {"key": "k", "value": 1, "tier": "memory"}
        assert call(router.server_port, "GET", "/kv/none")[0] == 404 and call(router.server_port, "GET", "/x")[0] == 404
        assert call(dead.server_port, "GET", "/kv/k")[0] == 502
        assert call(shard.server_port, "GET", "/health")[0] == 200
    finally:
        for s in servers:
            s.shutdown()
            s.server_close()
