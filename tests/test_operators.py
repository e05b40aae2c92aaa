"""The store's operators on small literal inputs."""

from datetime import datetime
from random import Random

import pytest
from pyspark.sql import functions as F

from stratakv.functions import codec
from stratakv.functions.xxh3 import xxh3
from stratakv.operators import lru, migrate, replica, ring, tiers, ttl
from stratakv.plans import config
from stratakv.sources import oplog
from stratakv.sources.objects import MemoryBackend, ObjectTier, ParquetBackend, open_backend

AS_OF = "2024-01-10 00:00:00"
ENTRY = "key string, value string, created_at timestamp_ntz, updated_at timestamp_ntz, ttl_secs long"


def at(text):
    return datetime.fromisoformat(text)


def entries(spark, *rows):
    """``(key, value, created, updated or None, ttl)``"""
    return spark.createDataFrame([(k, v, at(c), at(u or c), t) for k, v, c, u, t in rows], ENTRY)


def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def column(df, name):
    return sorted(r[name] for r in df.collect())


# -- log -------------------------------------------------------------------------------------------------------


def log(spark, *ops):
    return spark.createDataFrame([(k + 1, at("2024-01-01") , o, key, v, t, 0) for k, (o, key, v, t) in enumerate(ops)], oplog.OPLOG)


def test_latest_write_wins_and_a_delete_hides(spark):
    df = log(spark, ("put", "a", "1", 5), ("put", "b", "1", None), ("put", "a", "2", None), ("delete", "b", None, None), ("get", "a", None, None))
    assert [(r.key, r.value, r.ttl_secs) for r in oplog.live(df).collect()] == [("a", "2", None)]


def test_put_returns_what_it_replaces(spark):
    df = log(spark, ("put", "k", "v1", None), ("put", "k", "v2", None), ("delete", "k", None, None), ("put", "k", "v3", None))
    assert [r.previous for r in oplog.previous_values(df).orderBy("seq").collect()] == [None, "v1", "v2", None]
    assert [r.delta for r in oplog.count_trail(df).orderBy("seq").collect()] == [1, 0, -1, 1]


def test_empty_log(spark):
    df = spark.createDataFrame([], oplog.OPLOG)
    assert oplog.live(df).count() == 0 and oplog.previous_values(df).count() == 0


# -- tiers -----------------------------------------------------------------------------------------------------


@pytest.fixture
def three(spark):
    row = lambda *r: spark.createDataFrame([(k, v, at("2024-01-01")) for k, v in r], "key string, value string, created_at timestamp_ntz")
    return {"memory": row(("a", "m")), "disk": row(("a", "d"), ("b", "d")), "object": row(("b", "o"), ("c", "o"))}


def test_first_tier_wins(spark, three):
    got = {r.key: (r.value, r.tier) for r in tiers.lookup(keys(spark, "a", "b", "c", "d", "a"), three).collect()}
    assert got == {"a": ("m", "memory"), "b": ("d", "disk"), "c": ("o", "object"), "d": (None, None)}


def test_contains_and_delete(spark, three):
    assert column(tiers.contains(keys(spark, "c", "d"), three), "key") == ["c"]
    left, marks = tiers.delete_everywhere(keys(spark, "a", "d"), three)
    assert {r.key: r.deleted for r in marks.collect()} == {"a": True, "d": False}
    assert column(tiers.stacked(left), "key") == ["b", "b", "c"]


def test_remove_batch_counts_what_was_there(spark, three):
    left, n = tiers.remove_batch(three["disk"], keys(spark, "a", "a", "zz"))
    assert n.first().removed == 1 and column(left, "key") == ["b"]


def test_promotion_copies_lower_hits(spark, three):
    found = tiers.lookup(keys(spark, "b", "c", "d"), three)
    assert column(tiers.promoted(found, three["memory"]), "key") == ["a", "b", "c"]


def test_usage_thresholds(spark):
    df = entries(spark, ("k", "x" * 80, "2024-01-01", None, None))
    u = tiers.usage(df, 100).first()
    assert (u.usage_percent, u.migrate, u.pressure) == (80.0, True, False)
    assert not tiers.usage(df, 100, cache_only=True).first().migrate
    assert tiers.usage(df.limit(0), 100).first().bytes == 0


# -- expiry ----------------------------------------------------------------------------------------------------


def test_age_equal_to_ttl_is_not_expired(spark):
    df = entries(spark, ("k", "v", "2024-01-09", None, 86_400), ("l", "v", "2024-01-08 23:59:59", None, 86_400))
    assert column(ttl.expired_keys(df, [], AS_OF), "key") == ["l"]


def test_own_ttl_does_not_override_a_rule(spark):
    df = entries(spark, ("p/1", "v", "2024-01-01", None, 10**9), ("p/2", "v", "2024-01-01", "2024-01-09 12:00:00", None), ("q", "v", "2024-01-01", None, None))
    assert column(ttl.expired_keys(df, [("p/", 3600)], AS_OF), "key") == ["p/1", "p/2"]


def test_first_declared_rule_counts(spark):
    got = keys(spark, "abc", "xyz").select("key", ttl.rule_ttl(F.col("key"), [("a", 3600), ("ab", 86_400)]).alias("t")).collect()
    assert {r.key: r.t for r in got} == {"abc": 3600, "xyz": None}


def test_sweep_looks_on_disk_only(spark):
    disk = entries(spark, ("t/1", "v", "2024-01-01", None, None))
    obj = entries(spark, ("t/1", "v", "2024-01-01", None, None), ("t/2", "v", "2024-01-01", None, None)).select("key", "value", "created_at")
    left, gone = ttl.sweep({"disk": disk, "object": obj}, [("t/", 60)], AS_OF)
    assert column(gone, "key") == ["t/1"] and column(left["object"], "key") == ["t/2"]
    assert column(ttl.sweep({"disk": disk, "object": obj}, [("t/", 60)], AS_OF, all_tiers=True)[1], "key") == ["t/1", "t/2"]


@pytest.mark.parametrize(("text", "rules"), [("a:1h,ab:1d", [("a", 3600), ("ab", 86_400)]), ("x:y:1h", []), ("p:5", [("p", 5)]), (":1h", [("", 3600)]), ("p:zz", []), ("", []), (" a : 2m , b", [("a", 120)])])
def test_rules_text(text, rules):
    assert config.parse_ttl_rules(text) == rules


def test_configuration_defaults_are_silent():
    c = config.StoreConfig.from_env({"MEMORY_MAX_SIZE_MB": "junk", "TTL_RULES": "app/:7d", "POD_NAME": "kv-2", "CACHE_ONLY": "yes"})
    assert (c.memory_bytes, c.ttl_rules, c.shard_id, c.cache_only) == (256 << 20, [("app/", 604_800)], 2, False)
    assert config.pod_shard("nope") == 0
    assert config.proxy_addresses({"TOTAL_SHARDS": "2"})[1].startswith("stratakv-1.stratakv.default.svc")
    assert config.proxy_addresses({"SHARD_ADDRESSES": "a:1, b:2"}) == ["a:1", "b:2"]


# -- migration -------------------------------------------------------------------------------------------------


def test_candidates_come_in_key_order(spark):
    df = entries(spark, ("k2", "v", "2024-01-01", None, None), ("k1", "v", "2024-01-05", None, None), ("k0", "v", "2024-01-10", None, None))
    assert [(r.key, r.reason) for r in migrate.candidates(df, AS_OF, 86_400, 1).collect()] == [("k1", "age")]
    assert [(r.key, r.reason) for r in migrate.candidates(df, AS_OF, 86_400, 9, pressure=True).collect()] == [("k0", "space_pressure"), ("k1", "age"), ("k2", "age")]


def test_migration_moves_and_replaces(spark):
    df = entries(spark, ("a", "new", "2024-01-01", None, 5), ("b", "v", "2024-01-10", None, None))
    old = migrate.to_objects(entries(spark, ("a", "old", "2023-01-01", None, None)))
    disk, objects = migrate.migrate(df, old, migrate.candidates(df, AS_OF, 86_400, 10))
    assert column(disk, "key") == ["b"]
    assert [(r.object_key, r.value, r.size_bytes, r.created_at) for r in objects.collect()] == [("data/61", "new", 3, at("2024-01-01"))]


# -- caches ----------------------------------------------------------------------------------------------------


def test_cache_limits():
    c = lru.Cache(10)
    assert [c.put(k, 5) for k in ("k1", "k2", "k3")] == [[], [], ["k1"]]
    c = lru.Cache(15)
    for k in ("k1", "k2", "k3"):
        c.put(k, 5)
    c.get("k1")
    assert c.put("k4", 5) == ["k2"]
    assert c.put("big", 100) == ["k3", "k1", "k4"] and c.size == 100  # over the limit, but kept
    c = lru.Cache(1 << 20, 0)
    c.put("a", 1)
    assert len(c.held) == 1
    c.put("a", 10)
    assert c.size == 10 and c.counts["a"] == 1
    assert c.get("a") and not c.get("b") and (c.hits, c.misses) == (1, 1)
    c.clear()
    assert (c.size, c.hits) == (0, 1)


def test_simulation_by_shard(spark):
    ops = [(0, 1, "put", "a", 5), (1, 2, "put", "a", 5), (0, 3, "put", "b", 5), (0, 4, "get", "a", 0), (0, 5, "put", "c", 5), (0, 6, "contains", "b", 0), (0, 7, "delete", "a", 0), (0, 8, "clear", "", 0), (1, 9, "get", "a", 0)]
    rows = lru.simulate(spark.createDataFrame(ops, "shard int, seq long, op string, key string, size long"), 10).orderBy("seq").collect()
    assert [(r.seq, r.hit, r.evicted) for r in rows] == [(1, None, []), (2, None, []), (3, None, []), (4, True, []), (5, None, ["b"]), (6, False, []), (7, True, []), (8, None, []), (9, True, [])]
    assert rows[7].entries == 0 and rows[7].hits == 1 and rows[8].bytes == 5


def test_read_through(spark):
    ops = [(0, 1, "get", "a", 4), (0, 2, "get", "a", 4), (0, 3, "get", "none", None), (0, 4, "get", "none", None)]
    rows = lru.simulate(spark.createDataFrame(ops, "shard int, seq long, op string, key string, size long"), 10, read_through=True).orderBy("seq").collect()
    assert [r.hit for r in rows] == [False, True, False, False]


def test_no_task_has_the_whole_log(spark):
    """One shard's log is dealt over tasks, with the hits of one pass over it: distances in a cycle of 20 keys hit, others miss."""
    n = 500_000
    key = F.when(F.col("id") % 1000 < 500, F.col("id") % 20).otherwise(F.col("id") % 400 + 100).cast("string")
    hits = lru.touches(spark.range(n).select((F.col("id") + 1).alias("seq"), key.alias("key")), 20)
    tasks = hits.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits")).collect()
    assert sum(r.rows for r in tasks) == n and sum(r.hits for r in tasks) == 500 * 480
    assert max(r.rows for r in tasks) < n / 2


def cached(log, *limits, read_through=False):
    """``log`` of ``(shard, seq, op, key, size)`` through plain caches, one for each shard."""
    caches, out = {}, []
    for s, seq, op, key, size in sorted(log, key=lambda r: r[:2]):
        c = caches.setdefault(s, lru.Cache(*limits))
        hit, evicted = c.step(op, key, -1 if size is None else size, read_through)
        out.append((s, seq, op, key, hit, evicted, len(c.held), c.size, c.hits, c.misses))
    return out


@pytest.mark.parametrize(("limits", "keys", "read_through"), [((60,), 40, False), ((60,), 40, True), ((1 << 62, 20), 40, True), ((1 << 62, 20), 21, True), ((1 << 62,), 300, False)])
def test_chunks_go_on_from_each_other(spark, monkeypatch, limits, keys, read_through):
    """Also where hardly anything is evicted, so that each chunk's end depends on those of all before it."""
    monkeypatch.setattr(lru, "CHUNK", 100)
    random = Random(7)
    log = [(random.choice([0, 0, 0, 2, 5]), i, random.choice(["get"] * 8 + ["put"] * 6 + ["delete", "contains"]) if i % 400 else "clear", f"k{int(keys * random.random() ** 3)}", random.choice([None, 0, 3, 9, 70])) for i in range(1, 1501)]
    got = lru.simulate(spark.createDataFrame(log, "shard int, seq long, op string, key string, size long"), *limits, read_through=read_through).orderBy("shard", "seq").collect()
    assert [tuple(r) for r in got] == cached(log, *limits, read_through=read_through)


@pytest.mark.parametrize("entries", [0, 1, 3, 8])
def test_touches_in_chunks(spark, monkeypatch, entries):
    """Chunks with fewer keys than the cache holds, in which what was held before lives on, and others."""
    monkeypatch.setattr(lru, "CHUNK", 100)
    random = Random(3)
    log = [(random.randrange(2), i, "get", f"k{int(random.choice([2, 12]) * random.random()) if i // 150 % 2 else i // 300}", 0) for i in range(1200)]
    got = lru.touches(spark.createDataFrame(log, "shard int, seq long, op string, key string, size long"), entries).orderBy("seq").collect()
    assert [tuple(r) for r in got] == sorted((seq, key, hit) for _, seq, _, key, hit, *_ in cached(log, 1 << 62, entries, read_through=True))


def test_chunks_that_wait_for_each_other(spark, monkeypatch):
    """A cache that never turns over: the start of every chunk is known only after all before, most are played one by one."""
    monkeypatch.setattr(lru, "CHUNK", 20)
    log = [(0, i, "put", f"k{i}", 1) if i % 20 < 2 else (0, i, "get", f"k{i % 240}", 1) for i in range(240)]
    got = lru.simulate(spark.createDataFrame(log, "shard int, seq long, op string, key string, size long"), 1 << 62).orderBy("seq").collect()
    assert [tuple(r) for r in got] == cached(log, 1 << 62)


def test_hit_rate_reads_no_whole_log(spark):
    """The sums come from several tasks: before, one held all of the log."""
    log = spark.range(300_000).select((F.col("id") + 1).alias("seq"), (F.col("id") % 30 * (F.col("id") % 60 < 30).cast("int")).cast("string").alias("key"))
    hits = lru.touches(log, 20)
    assert hits.select(F.spark_partition_id()).distinct().count() > 1
    # of 60 accesses the 29 other keys miss, and key 0 once after them; the very first access misses too
    assert tuple(lru.hit_rate(hits).first())[:2] == (5_000 * 30 - 1, 5_000 * 30 + 1)


def test_hit_rate_without_accesses(spark):
    assert lru.hit_rate(spark.createDataFrame([], "hit boolean")).first().hit_rate == 0.0


# -- ring ------------------------------------------------------------------------------------------------------


def test_golden_hashes():
    assert xxh3("") == 0x2D06800538D394C2 and xxh3("key-0") == 9340302149712544120 and xxh3("shard-0-vn-0") == 0xF7F418FBDE06FF6E


@pytest.mark.parametrize(("shards", "nodes", "counts"), [(3, 150, [3773, 3255, 2972]), (3, 10, [2205, 4407, 3388]), (3, 200, [3627, 3371, 3002]), (5, 150, [2262, 2120, 1859, 1933, 1826])])
def test_spread_of_keys(shards, nodes, counts):
    import numpy as np

    r = ring.Ring(shards, nodes)
    assert len(r.points[0]) == shards * nodes
    got = np.bincount(r.route_hashes(np.array([xxh3(f"test-key-{k}") for k in range(10_000)], np.uint64)), minlength=shards)
    assert got.tolist() == counts


def test_routing(spark):
    r = ring.Ring(3)
    assert r.route("my-test-key") == r.route("my-key") == 1
    assert sum(r.owns(f"key-{k}", 0) for k in range(1000)) == 376
    import numpy as np

    top = r.points[0][-1]
    assert r.route_hashes(np.array([top, top + np.uint64(1), 0], np.uint64)).tolist() == [r.points[1][-1], r.points[1][0], r.points[1][0]]
    assert ring.Ring(0).route("x") == 0
    got = {x.key: x.s for x in keys(spark, "my-key", "/my-key", "//my-key").select("key", r.shard_of(F.col("key")).alias("s")).collect()}
    assert got["my-key"] == got["/my-key"] == 1 and got["//my-key"] == r.route("/my-key")


def test_addresses(spark):
    known = ring.addresses(spark, [(0, "a"), (0, "b")])
    got = {r.key: r.address for r in ring.key_addresses(keys(spark, "my-key"), ring.Ring(3), known).collect()}
    assert got == {"my-key": None}
    assert ring.cluster_configs(2, 9000)[1]["addresses"] == [(0, "localhost:9000"), (1, "localhost:9001")]
    assert sum(r.percent for r in ring.Ring(3).distribution(spark).collect()) == pytest.approx(100)


# -- replication -----------------------------------------------------------------------------------------------


def writes(spark, n):
    return replica.numbered(log(spark, *[("put", f"k{k}", "v", None) for k in range(n)]))


def peers(spark, *rows):
    return spark.createDataFrame(list(rows), "replica_id int, last_acked_sequence long, is_online boolean")


def test_log_reading(spark):
    assert [r.seq for r in replica.entries_since(writes(spark, 5), 2, 9).collect()] == [3, 4, 5]
    assert replica.entries_since(writes(spark, 10), 0, 3).count() == 3
    assert column(replica.trimmed(writes(spark, 10), 5), "seq") == [6, 7, 8, 9, 10]
    assert replica.trimmed(writes(spark, 3), 0).count() == 0


def test_acknowledgements(spark):
    acks = spark.createDataFrame([(1, 1, 5, True), (2, 1, 3, True), (3, 9, 8, True), (4, 2, 4, True), (5, 2, 7, False)], "ack_order long, replica_id int, seq long, online boolean")
    got = {r.replica_id: (r.last_acked_sequence, r.is_online) for r in replica.peer_states(spark.createDataFrame([(1,), (2,), (3,)], "replica_id int"), acks).collect()}
    assert got == {1: (3, True), 2: (4, False), 3: (0, False)}


def test_lag_and_health(spark):
    one = replica.stats(writes(spark, 2), peers(spark, (1, 1, True), (2, 0, False))).first()
    assert (one.current_sequence, one.log_size, one.peers, one.online, one.max_lag, one.healthy) == (2, 2, 2, 1, 2, False)
    assert replica.stats(writes(spark, 2), peers(spark, (1, 2, True))).first().healthy
    none = peers(spark).limit(0)
    assert replica.stats(writes(spark, 2), none).first().max_lag == 0 and replica.min_acked(none).first().min_acked == 0
    assert replica.truncated(writes(spark, 5), none).count() == 5
    assert column(replica.truncated(writes(spark, 5), peers(spark, (1, 3, True), (2, 3, True))), "seq") == [4, 5]


def test_merge_keeps_order_and_repeats(spark):
    got = replica.merged(writes(spark, 3), writes(spark, 2)).collect()
    assert [(r.seq, r.arrival) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert replica.highest_sequence(writes(spark, 3).limit(0), 7).first().sequence == 7


def test_sequences_are_dense(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "t long, v string").repartition(5)
    got = replica.sequenced(df, "t").orderBy("t").collect()
    assert [r.seq for r in got] == list(range(1, 1001)) and replica.sequenced(df.limit(0), "t").count() == 0
    handed, rest = replica.drained(writes(spark, 1))
    assert (handed.count(), rest.count()) == (1, 0)


# -- codecs ----------------------------------------------------------------------------------------------------


def test_values(spark):
    df = spark.createDataFrame([(b"value1",), (b"",), (None,)], "v binary").select("v", codec.compress("v").alias("z"))
    got = df.select("v", codec.is_compressed(F.col("z")).alias("c"), codec.decompress(F.col("z")).alias("d"), codec.decompress(F.col("v")).alias("p")).collect()
    assert [(r.c, r.d, r.p) for r in got] == [(True, b"value1", b"value1"), (True, b"", b""), (None, None, None)]


@pytest.mark.parametrize(("text", "out"), [("123", "123"), ('{"a":1}', '{"a":1}'), ("hello", '"hello"'), ("NaN", '"NaN"'), ('{"a":1} x', '"{\\"a\\":1} x"'), ('{"a":1,"a":2}', '{"a":1,"a":2}'), ("null", "null"), ("", '""'), (None, None)])
def test_json_embedding(text, out):
    assert codec.embed_text(text) == out


def test_records():
    legacy = b'{"value":[104,105],"created_at":"2024-01-01T00:00:00Z","updated_at":"2024-01-01T00:00:01.5Z"}'
    value, created, updated, secs = codec.decode_record(legacy)
    assert (value, created, updated, secs) == (b"hi", at("2024-01-01"), at("2024-01-01 00:00:01.500000"), None)
    for v in (b"", b"x" * 70_000, bytes(range(256))):
        for t in (None, 0, 200, 70_000, 1 << 40):
            r = codec.encode_record(v, created, updated, t)
            assert r[0] == 1 and codec.decode_record(r) == (v, created, updated, t)


def test_record_columns(spark):
    good = codec.encode_record(b"a", at("2024-01-01"), at("2024-01-01"), 5)
    df = spark.createDataFrame([(good,), (b"\x01\x94",), (b"{}",)], "d binary")
    got = df.select(codec.read_records("d").alias("r"), codec.upgrade_records("d").alias("u")).collect()
    assert got[0].r.value == b"a" and got[0].r.error is None
    assert got[1].r.error and got[2].r.error and got[2].u == b"{}"


# -- objects ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_object_tier(spark, tmp_path, kind):
    backend = MemoryBackend(spark) if kind == "memory" else ParquetBackend(spark, str(tmp_path / "o"))
    tier = ObjectTier(backend)
    rows = spark.createDataFrame([("folder/key1", "hello world"), ("folder/key2", "b"), ("other/key3", "c")], "key string, value string")
    tier.put(rows, AS_OF)
    assert column(tier.list("folder/"), "key") == ["folder/key1", "folder/key2"]
    head = tier.head(keys(spark, "folder/key1")).first()
    assert (head.size_bytes, head.original_key) == (11, "folder/key1") and "value" not in head
    assert column(tier.exists(keys(spark, "other/key3", "zz")), "key") == ["other/key3"]
    assert tier.delete_batch(keys(spark, "folder/key1", "other/key3", "other/key3", "zz")) == 2
    assert tier.get(keys(spark, "folder/key2")).first().value == "b" and backend.objects().count() == 1


def test_backend_choice(spark, tmp_path):
    assert isinstance(open_backend(spark), MemoryBackend)
    assert isinstance(open_backend(spark, path=str(tmp_path)), ParquetBackend)
