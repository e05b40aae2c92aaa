"""The queries of the store's operators over the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions import codec
from stratakv.operators import lru, migrate, replica, ring, tiers, ttl
from stratakv.session import prepare, scratch_dir, table
from stratakv.sources import oplog
from stratakv.sources.objects import MemoryBackend, ObjectTier

AS_OF = "2024-01-31 00:00:00"
#: Overlapping rules, so that the first match differs from the longest.
RULES = [("app/1", 86_400), ("app/", 2 * 86_400), ("tmp/", 3_600)]
AGE, BATCH = 86_400, 10
LRU_ENTRIES, LRU_BYTES, SHARDS = 20, 160, 3
DISK_BYTES = 4_096
BLOB_BYTES = 4_096
PEERS = 3
#: User numbers whose keys' hashes the SQL side carries as constants (the hash itself is pinned by golden values).
SQL_USERS = 2_048
SIMULATED = 10_000

PRELUDE = """
WITH oplog AS (SELECT event_id + 1 AS seq, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op,
  CASE user_id % 3 WHEN 0 THEN 'app/' WHEN 1 THEN 'tmp/' ELSE 'keep/' END || user_id AS key, CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS value,
  CASE WHEN event_type IN ('signup', 'purchase') AND event_id % 4 = 0 THEN (event_id % 7 + 1) * 86400 END AS ttl_secs, CAST(event_id % 3 AS INTEGER) AS source_replica FROM events),
writes AS (SELECT * FROM oplog WHERE op <> 'get'),
last AS (SELECT * FROM writes QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, value, ts AS created_at, ts AS updated_at, ttl_secs, seq FROM last WHERE op = 'put'),
l1 AS (SELECT key, value, created_at FROM live WHERE seq % 5 = 0), l2 AS (SELECT key, value, created_at FROM live WHERE seq % 5 < 3),
l3 AS (SELECT key, 'cold:' || value AS value, created_at FROM live WHERE seq % 5 IN (2, 3)),
keys AS (SELECT DISTINCT key FROM oplog), gone AS (SELECT DISTINCT key FROM oplog WHERE seq % 401 = 0)
"""
OWN = f"coalesce(TIMESTAMP '{AS_OF}' - updated_at > to_seconds(ttl_secs), false)"
RULE_TTL = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN {s}" for p, s in RULES) + " END"
RULE = f"coalesce(TIMESTAMP '{AS_OF}' - created_at > to_seconds({RULE_TTL}), false)"
OLD = f"TIMESTAMP '{AS_OF}' - created_at > to_seconds({AGE})"
MOVED = f"cand AS (SELECT * FROM live WHERE {OLD} ORDER BY key LIMIT {BATCH}), old AS (SELECT 'data/' || lower(hex(key)) AS object_key, 'old' AS value, CAST(3 AS BIGINT) AS size_bytes, created_at FROM live WHERE seq % 5 IN (2, 3)), moved AS (SELECT 'data/' || lower(hex(key)) AS object_key, value, octet_length(encode(value)) AS size_bytes, created_at FROM cand)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: str = PRELUDE) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            ORACLE_SQL[name] = prelude + sql
        return f

    return add


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(table(spark, sf_dir, "events"))


def live_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live(log_of(spark, sf_dir))


def three_tiers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    live = live_of(spark, sf_dir)
    part = F.col("seq") % 5
    cold = live.where(part.isin(2, 3)).select("key", F.concat(F.lit("cold:"), F.col("value")).alias("value"), "created_at")
    return {"memory": live.where(part == 0).select("key", "value", "created_at"), "disk": live.where(part < 3).select("key", "value", "created_at"), "object": cold}


def all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(spark, sf_dir).select("key").distinct()


def gone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(spark, sf_dir).where("seq % 401 = 0").select("key").distinct()


# -- state -----------------------------------------------------------------------------------------------------


@query("q01_live_state", "SELECT * FROM live")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir)


@query("q02_previous_value", "SELECT seq, key, op, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS previous FROM writes")
def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.previous_values(log_of(spark, sf_dir))


@query("q03_point_get", "SELECT key, value FROM live WHERE key IN ('app/3', 'tmp/4', 'keep/5', 'none')")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.point_get(live_of(spark, sf_dir), ["app/3", "tmp/4", "keep/5", "none"]).select("key", "value")


@query("q02b_entry_count", "SELECT key, sum(d)::BIGINT AS entries FROM (SELECT key, (op = 'put')::INT - coalesce(lag(op) OVER (PARTITION BY key ORDER BY seq) = 'put', false)::INT AS d FROM writes) GROUP BY key")
def entry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.count_trail(log_of(spark, sf_dir)).groupBy("key").agg(F.sum("delta").cast("long").alias("entries"))


# -- tiers -----------------------------------------------------------------------------------------------------


@query("q04_tier_lookup", "SELECT key, coalesce(l1.value, l2.value, l3.value) AS value, coalesce(l1.created_at, l2.created_at, l3.created_at) AS created_at, CASE WHEN l1.value IS NOT NULL THEN 'memory' WHEN l2.value IS NOT NULL THEN 'disk' WHEN l3.value IS NOT NULL THEN 'object' END AS tier FROM keys LEFT JOIN l1 USING (key) LEFT JOIN l2 USING (key) LEFT JOIN l3 USING (key)")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.lookup(all_keys(spark, sf_dir), three_tiers(spark, sf_dir))


@query("q05_contains_any", "SELECT key FROM keys WHERE key IN (SELECT key FROM l1 UNION SELECT key FROM l2 UNION SELECT key FROM l3)")
def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.contains(all_keys(spark, sf_dir), three_tiers(spark, sf_dir))


@query("q06_delete_all_tiers", "SELECT key, key IN (SELECT key FROM l1 UNION SELECT key FROM l2 UNION SELECT key FROM l3) AS deleted FROM gone")
def delete_all_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.delete_everywhere(gone_keys(spark, sf_dir), three_tiers(spark, sf_dir))[1]


@query("q06b_tiers_after_delete", "SELECT tier, count(*) AS n FROM (SELECT 'memory' AS tier, key FROM l1 UNION ALL SELECT 'disk', key FROM l2 UNION ALL SELECT 'object', key FROM l3) WHERE key NOT IN (SELECT key FROM gone) GROUP BY tier")
def tiers_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = tiers.delete_everywhere(gone_keys(spark, sf_dir), three_tiers(spark, sf_dir))
    return tiers.stacked(left).groupBy("tier").agg(F.count("*").alias("n"))


@query("q06c_remove_batch", "SELECT count(*) AS removed FROM gone WHERE key IN (SELECT key FROM l2)")
def remove_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.remove_batch(three_tiers(spark, sf_dir)["disk"], gone_keys(spark, sf_dir))[1]


@query("q06d_promotion", "SELECT key, value FROM l1 UNION ALL SELECT key, value FROM (SELECT key, value FROM l2 UNION ALL SELECT key, value FROM l3 WHERE key NOT IN (SELECT key FROM l2)) WHERE key IN (SELECT key FROM gone) AND key NOT IN (SELECT key FROM l1)")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = three_tiers(spark, sf_dir)
    return tiers.promoted(tiers.lookup(gone_keys(spark, sf_dir), three), three["memory"]).select("key", "value")


@query("q07_prefix_list", "SELECT key FROM live WHERE starts_with(key, 'app/') ORDER BY key")
def prefix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir).where(F.col("key").startswith("app/")).select("key").orderBy("key")


@query("q08_meta_scan", "SELECT key, created_at, updated_at, ttl_secs FROM live")
def meta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir).select("key", "created_at", "updated_at", "ttl_secs")


@query("q08b_entry_info", "SELECT key, created_at, updated_at, octet_length(encode(value)) AS size_bytes FROM live")
def entry_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir).select("key", "created_at", "updated_at", F.octet_length("value").cast("long").alias("size_bytes"))


@query("q09_object_keys", "SELECT key, 'data/' || lower(hex(key)) AS object_key FROM live")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir).select("key", F.concat(F.lit("data/"), codec.object_key(F.col("key"))).alias("object_key"))


# -- expiry ----------------------------------------------------------------------------------------------------


@query("q10_ttl_expired", f"SELECT key, CASE WHEN {OWN} THEN 'own' ELSE 'rule' END AS reason FROM live WHERE {OWN} OR {RULE}")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl.expired_keys(live_of(spark, sf_dir), RULES, AS_OF)


@query("q11_ttl_survivors", f"SELECT key, value FROM live WHERE NOT ({OWN} OR {RULE})")
def ttl_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ttl.sweep({"disk": live_of(spark, sf_dir)}, RULES, AS_OF)[0]["disk"].select("key", "value")


@query("q11b_ttl_sweep_tiers", f"SELECT tier, count(*) AS n FROM (SELECT 'memory' AS tier, key FROM l1 UNION ALL SELECT 'object', key FROM l3) WHERE key NOT IN (SELECT key FROM live WHERE seq % 5 < 3 AND ({OWN} OR {RULE})) GROUP BY tier")
def ttl_sweep_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = three_tiers(spark, sf_dir)
    left, _ = ttl.sweep(three | {"disk": live_of(spark, sf_dir).where("seq % 5 < 3")}, RULES, AS_OF)
    return tiers.stacked({t: left[t] for t in ("memory", "object")}).groupBy("tier").agg(F.count("*").alias("n"))


@query("q12_ttl_rule_match", f"SELECT key, CAST({RULE_TTL} AS BIGINT) AS rule_ttl FROM live")
def ttl_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(spark, sf_dir).select("key", ttl.rule_ttl(F.col("key"), RULES).alias("rule_ttl"))


# -- migration -------------------------------------------------------------------------------------------------


@query("q13_migration_age", f"SELECT key, 'age' AS reason FROM live WHERE {OLD} ORDER BY key LIMIT {BATCH}")
def migration_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.candidates(live_of(spark, sf_dir), AS_OF, AGE, BATCH).select("key", "reason")


@query("q14_migration_pressure", f"SELECT key, CASE WHEN {OLD} THEN 'age' ELSE 'space_pressure' END AS reason FROM live ORDER BY key LIMIT {4 * BATCH}")
def migration_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.candidates(live_of(spark, sf_dir), AS_OF, AGE, 4 * BATCH, pressure=True).select("key", "reason")


def _migrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = live_of(spark, sf_dir)
    old = migrate.to_objects(live.where((F.col("seq") % 5).isin(2, 3)).withColumn("value", F.lit("old")))
    return migrate.migrate(live, old, migrate.candidates(live, AS_OF, AGE, BATCH))


@query("q15a_disk_after_migration", f", {MOVED} SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM cand)")
def disk_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _migrated(spark, sf_dir)[0].select("key", "value")


@query("q15b_objects_after_migration", f", {MOVED} SELECT * FROM old WHERE object_key NOT IN (SELECT object_key FROM moved) UNION ALL SELECT * FROM moved")
def objects_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _migrated(spark, sf_dir)[1].select("object_key", "value", "size_bytes", "created_at")


@query("q16_stale_shadow", "SELECT key, CASE WHEN l2.key IS NOT NULL THEN l2.value ELSE l3.value END AS value, l2.key IS NOT NULL AS shadowed FROM l3 LEFT JOIN l2 USING (key)")
def stale_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the object tier as reads see them: a newer disk entry hides the object that was left behind."""
    three = three_tiers(spark, sf_dir)
    seen = tiers.lookup(three["object"], {"disk": three["disk"], "object": three["object"]})
    return seen.select("key", "value", (F.col("tier") == "disk").alias("shadowed"))


# -- caches ----------------------------------------------------------------------------------------------------

# an access hits if fewer than C other keys were touched since its key was: those j between whose own last touch is before
DISTANCE = f""", a AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS pv FROM oplog),
h AS (SELECT x.seq, x.key, x.pv IS NOT NULL AND (SELECT count(*) FROM a y WHERE y.seq > x.pv AND y.seq < x.seq AND coalesce(y.pv, 0) < x.pv) < {LRU_ENTRIES} AS hit FROM a x)"""


@query("q17_lru_hits", DISTANCE + " SELECT seq, key, hit FROM h")
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lru.touches(log_of(spark, sf_dir), LRU_ENTRIES)


@query("q18_lru_hit_rate", DISTANCE + " SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) / count(*) AS hit_rate FROM h")
def lru_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lru.hit_rate(lru_hits(spark, sf_dir))


def sharded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return log.select(ring.Ring(SHARDS).shard_of(F.col("key")).alias("shard"), "seq", "op", "key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("size"))


@query("q19_lru_bytes")
def lru_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte-limited cache for each shard over puts, gets and deletes; tests hold it against a plain simulation."""
    return lru.simulate(sharded_log(spark, sf_dir), LRU_BYTES).select("shard", "seq", "op", "key", "hit", F.array_join("evicted", ",").alias("evicted"), "entries", "bytes", "hits", "misses")


@query("q19b_lru_read_through")
def lru_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that miss bring the live entry in, evicting others; keys without one stay out."""
    live = live_of(spark, sf_dir).select("key", F.octet_length("value").alias("held"))
    reads = log_of(spark, sf_dir).where("op = 'get'").join(live, "key", "left")
    log = reads.select(ring.Ring(SHARDS).shard_of(F.col("key")).alias("shard"), "seq", "op", "key", F.col("held").alias("size"))
    return lru.simulate(log, LRU_BYTES, read_through=True).select("shard", "seq", "key", "hit", F.array_join("evicted", ",").alias("evicted"), "bytes")


@query("q20_cache_stats", "SELECT count(*) AS entries, coalesce(sum(octet_length(encode(value))), 0)::BIGINT AS bytes FROM l1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.usage(three_tiers(spark, sf_dir)["memory"], 0).select("entries", "bytes")


@query("q20b_engine_stats", "SELECT (SELECT count(*) FROM l1) AS memory_entries, (SELECT coalesce(sum(octet_length(encode(value))), 0)::BIGINT FROM l1) AS memory_bytes, (SELECT count(*) FROM l2) AS disk_entries, (SELECT coalesce(sum(octet_length(encode(value))), 0)::BIGINT FROM l2) AS disk_bytes, (SELECT count(*) FROM l3) AS object_entries, (SELECT coalesce(sum(octet_length(encode(value))), 0)::BIGINT FROM l3) AS object_bytes, CAST(0 AS BIGINT) AS migrations_completed")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = three_tiers(spark, sf_dir)
    return tiers.engine_stats(three["memory"], three["disk"], three["object"])


@query("q21_disk_usage", f", s AS (SELECT count(*) AS entries, sum(octet_length(encode(value)))::BIGINT AS bytes FROM live), u AS (SELECT *, bytes * 100.0::DOUBLE / {DISK_BYTES} AS usage_percent FROM s) SELECT *, usage_percent >= 80 AS migrate, usage_percent > 80 AS pressure FROM u")
def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.usage(live_of(spark, sf_dir), DISK_BYTES)


@query("q21b_recency", "SELECT key, max(seq) AS last_seq, row_number() OVER (ORDER BY max(seq) DESC) AS recency FROM oplog GROUP BY key")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lru.recency(log_of(spark, sf_dir))


# -- sharding --------------------------------------------------------------------------------------------------


def _points_sql() -> str | None:
    """The ring's points as a table; None without the hash's package, as there is no sharding then."""
    try:
        points, shards = ring.Ring(SHARDS).points
    except ImportError:
        return None
    return "p(point, shard) AS (VALUES " + ", ".join(f"({x}::UBIGINT, {s})" for x, s in zip(points.tolist(), shards.tolist(), strict=True)) + ")"


#: The shard of a hash ``h``: that of the next point, or of the first one.
ROUTE = "coalesce(p.shard, (SELECT arg_min(shard, point) FROM p))"


def _ring_sql() -> str | None:
    if (points := _points_sql()) is None:
        return None
    from stratakv.functions.xxh3 import xxh3

    keys = [("app/", "tmp/", "keep/")[u % 3] + str(u) for u in range(SQL_USERS)]
    return f", {points}, k(key, h) AS (VALUES " + ", ".join(f"('{k}', {xxh3(k)}::UBIGINT)" for k in keys) + f"), routed AS (SELECT key, {ROUTE} AS shard_id FROM (SELECT key, h FROM keys JOIN k USING (key)) q ASOF LEFT JOIN p ON q.h <= p.point)"


def _simulated_sql() -> str | None:
    if (points := _points_sql()) is None:
        return None
    from stratakv.functions.xxh3 import xxh3

    hashes = ", ".join(str(xxh3(f"test-key-{i}")) for i in range(SIMULATED))
    return f"WITH {points}, q AS (SELECT unnest([{hashes}]::UBIGINT[]) AS h) SELECT {ROUTE} AS shard_id, count(*) AS n_keys FROM q ASOF LEFT JOIN p ON q.h <= p.point GROUP BY 1"


RING_SQL = _ring_sql()


def with_ring(sql: str) -> str | None:
    return RING_SQL and RING_SQL + sql


@query("q22_shard_of_keys", with_ring(" SELECT key, shard_id FROM routed"))
def shard_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_keys(spark, sf_dir).select("key", ring.Ring(SHARDS).shard_of(F.col("key")).alias("shard_id"))


@query("q22b_owned_keys", with_ring(" SELECT key FROM routed WHERE shard_id = 0"))
def owned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_of_keys(spark, sf_dir).where("shard_id = 0").select("key")


@query("q23_ring_distribution", _points_sql() and f"WITH {_points_sql()} SELECT shard AS shard_id, count(*) AS points, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM p) AS percent FROM p GROUP BY shard", "")
def ring_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.Ring(SHARDS).distribution(spark)


@query("q23b_simulate_distribution", _simulated_sql(), "")
def simulate_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.Ring(SHARDS).simulate(spark, SIMULATED)


@query("q24_shard_addresses", with_ring(" SELECT key, shard_id, CASE shard_id WHEN 0 THEN 'localhost:9000' WHEN 1 THEN 'localhost:9001' END AS address FROM routed"))
def shard_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 2 has no known address."""
    return ring.key_addresses(all_keys(spark, sf_dir), ring.Ring(SHARDS), ring.addresses(spark, [(0, "localhost:9000"), (1, "localhost:9001"), (0, "localhost:1")]))


# -- replication -----------------------------------------------------------------------------------------------

PEER_SQL = f""", acks AS (SELECT seq AS ack_order, CAST(seq % {PEERS} AS INTEGER) AS replica_id, seq - seq % 11 AS acked, seq % 13 <> 0 AS online FROM writes WHERE seq % 5 = 0),
peers AS (SELECT CAST(r AS INTEGER) AS replica_id, coalesce((SELECT arg_max(acked, ack_order) FROM acks WHERE acks.replica_id = r AND online), 0)::BIGINT AS last_acked_sequence, coalesce((SELECT arg_max(online, ack_order) FROM acks WHERE acks.replica_id = r), false) AS is_online FROM range({PEERS + 1}) t(r))"""


def peers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four known replicas, of which the last never acknowledges."""
    acks = oplog.writes(log_of(spark, sf_dir)).where("seq % 5 = 0").select(F.col("seq").alias("ack_order"), (F.col("seq") % PEERS).cast("int").alias("replica_id"), (F.col("seq") - F.col("seq") % 11).alias("seq"), (F.col("seq") % 13 != 0).alias("online"))
    return replica.peer_states(spark.range(PEERS + 1).select(F.col("id").cast("int").alias("replica_id")), acks)


@query("q25_log_since_batch", "SELECT seq, op, key, value FROM writes WHERE seq > 500 ORDER BY seq LIMIT 100")
def log_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.entries_since(replica.numbered(log_of(spark, sf_dir)), 500, 100).select("seq", "op", "key", "value")


@query("q25b_sequence", "SELECT key, op, row_number() OVER (ORDER BY ts, seq) AS number FROM writes")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense sequence numbers of the writes, without a window over all rows."""
    writes = oplog.writes(log_of(spark, sf_dir)).select("key", "op", "ts", F.col("seq").alias("event"))
    return replica.sequenced(writes, "ts", "event").select("key", "op", F.col("seq").alias("number"))


@query("q26a_log_trim", "SELECT seq, key FROM writes ORDER BY seq DESC LIMIT 250")
def log_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.trimmed(replica.numbered(log_of(spark, sf_dir)), 250).select("seq", "key")


@query("q26b_truncate_acked", PEER_SQL + " SELECT seq, key FROM writes WHERE seq > (SELECT min(last_acked_sequence) FROM peers WHERE replica_id < 3)")
def truncate_acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.truncated(replica.numbered(log_of(spark, sf_dir)), peers_of(spark, sf_dir).where("replica_id < 3")).select("seq", "key")


@query("q27_peer_ack_latest", PEER_SQL + " SELECT * FROM peers")
def peer_ack_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers_of(spark, sf_dir)


@query("q28_replication_lag", PEER_SQL + ", s AS (SELECT (SELECT max(seq) FROM writes) AS current_sequence, (SELECT count(*) FROM writes) AS log_size, count(*) AS peers, count(*) FILTER (WHERE is_online) AS online, min(last_acked_sequence) AS least FROM peers) SELECT current_sequence, log_size, peers, online, greatest(current_sequence - least, 0) AS max_lag, online = peers AND greatest(current_sequence - least, 0) < 1000 AS healthy FROM s")
def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.stats(replica.numbered(log_of(spark, sf_dir)), peers_of(spark, sf_dir))


@query("q29_receive_merge", "SELECT seq, key, arrival FROM (SELECT seq, key, 0 AS arrival FROM writes WHERE source_replica = 0 UNION ALL SELECT seq, key, 1 FROM writes WHERE source_replica < 2) ORDER BY seq, arrival")
def receive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = replica.numbered(log_of(spark, sf_dir))
    return replica.merged(log.where("source_replica = 0"), log.where("source_replica < 2")).select("seq", "key", "arrival")


@query("q29c_highest_pending", "SELECT max(seq) AS sequence FROM writes WHERE source_replica < 2")
def highest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = replica.numbered(log_of(spark, sf_dir))
    return replica.highest_sequence(replica.merged(log.where("source_replica = 0"), log.where("source_replica = 1")), 0)


@query("q29b_apply_drained", ", a AS (SELECT * FROM writes WHERE seq <= 3000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value, seq FROM a WHERE op = 'put'")
def apply_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower's state after it applied a drained part of the log: the latest sequence of each key."""
    return oplog.live(log_of(spark, sf_dir).where("seq <= 3000")).select("key", "value", "seq")


# -- objects and the engine ------------------------------------------------------------------------------------


def object_tier(spark: SparkSession, sf_dir: str) -> ObjectTier:
    tier = ObjectTier(MemoryBackend(spark))
    tier.put(live_of(spark, sf_dir).select("key", "value"), AS_OF)
    return tier


@query("q35_object_list", "SELECT key FROM live WHERE starts_with(key, 'keep/')")
def object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_tier(spark, sf_dir).list("keep/").select("key")


@query("q36_object_head", f"SELECT key, octet_length(encode(value)) AS size_bytes, TIMESTAMP '{AS_OF}' AS created_at, key AS original_key, 'application/octet-stream' AS content_type FROM live WHERE key IN (SELECT key FROM gone)")
def object_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_tier(spark, sf_dir).head(gone_keys(spark, sf_dir)).select("key", "size_bytes", "created_at", "original_key", "content_type")


@query("q37_object_exists", "SELECT key FROM live WHERE key IN (SELECT key FROM gone)")
def object_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_tier(spark, sf_dir).exists(gone_keys(spark, sf_dir)).select("key")


@query("q38_object_delete_batch", "SELECT key, value, (SELECT count(*) FROM gone WHERE key IN (SELECT key FROM live)) AS removed FROM live WHERE key NOT IN (SELECT key FROM gone)")
def object_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = object_tier(spark, sf_dir)
    n = tier.delete_batch(gone_keys(spark, sf_dir))
    return tier.get(live_of(spark, sf_dir).select("key")).select("key", "value", F.lit(n).cast("long").alias("removed"))


EARLY, LATE = "2024-01-01 00:00:00", "2024-01-30 12:00:00"


@query(
    "q39_engine_batches",
    f""", b AS (SELECT key, value, CASE WHEN seq % 2 = 0 THEN TIMESTAMP '{LATE}' ELSE TIMESTAMP '{EARLY}' END AS created_at FROM live WHERE key NOT IN (SELECT key FROM gone)),
k AS (SELECT * FROM b WHERE NOT {RULE}), m AS (SELECT key FROM k WHERE {OLD} ORDER BY key LIMIT {BATCH})
SELECT keys.key, k.value, CASE WHEN k.key IS NULL THEN NULL WHEN k.key IN (SELECT key FROM m) THEN 'object' ELSE 'disk' END AS tier FROM keys LEFT JOIN k ON keys.key = k.key""",
)
def engine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's life in batches: put, put again, delete, expire, migrate, then read every key that ever was."""
    from stratakv.plans.config import StoreConfig
    from stratakv.plans.engine import Engine

    engine = Engine(spark, StoreConfig(migration_batch=BATCH, migration_age_secs=AGE, ttl_rules=RULES), scratch_dir(spark))
    live = live_of(spark, sf_dir)
    engine.put_batch(live.select("key", "value"), EARLY)
    engine.put_batch(live.where("seq % 2 = 0").select("key", "value"), LATE)
    engine.delete_batch(gone_keys(spark, sf_dir))
    engine.expire(AS_OF)
    engine.migrate(AS_OF)
    return engine.get_batch(all_keys(spark, sf_dir)).select("key", "value", "tier")


# -- codecs ----------------------------------------------------------------------------------------------------


@query("q30_zstd_roundtrip", "SELECT doc_id, text AS value, true AS framed, true AS legacy_passes FROM documents", "")
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = raw.withColumn("packed", codec.compress("raw"))
    return packed.select("doc_id", codec.decompress(F.col("packed")).cast("string").alias("value"), codec.is_compressed(F.col("packed")).alias("framed"), (codec.decompress(F.col("raw")) == F.col("raw")).alias("legacy_passes"))


@query("q31_json_embed", """ SELECT event_id, CASE WHEN json_valid(t) THEN t ELSE CAST(to_json(t) AS VARCHAR) END AS embedded FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE props END AS t FROM events)""", "")
def json_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("event_type")).when(kind == 1, F.col("event_id").cast("string")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", codec.json_embed(text).alias("embedded"))


@query("q32_blob_split", f"SELECT octet_length(encode(text)) > {BLOB_BYTES} AS blob, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1", "")
def blob_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy((size > BLOB_BYTES).alias("blob")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


@query("q33_stream_fold", "SELECT * FROM live")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files, folded batch by batch."""
    from stratakv.streaming.replication import Fold

    path = scratch_dir(spark)
    log = log_of(spark, sf_dir)
    log.write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return Fold(spark).run(stream)


@query("q34_record_upgrade", "SELECT key, value, created_at, ttl_secs, true AS was_legacy, false AS is_legacy FROM live")
def record_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the older JSON format, rewritten in the binary one and read again."""
    stamp: Column = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    numbers = F.expr("transform(sequence(1, length(value)), i -> ascii(substring(value, i, 1)))")
    legacy = live_of(spark, sf_dir).select("key", F.to_json(F.struct(numbers.alias("value"), stamp.alias("created_at"), stamp.alias("updated_at"), "ttl_secs")).cast("binary").alias("raw"))
    both = legacy.select("key", codec.read_records("raw").alias("old"), codec.read_records(codec.upgrade_records("raw")).alias("new"))
    return both.select("key", F.col("new.value").cast("string").alias("value"), "new.created_at", "new.ttl_secs", F.col("old.legacy").alias("was_legacy"), F.col("new.legacy").alias("is_legacy"))


@query("q34b_legacy_batch", "SELECT key FROM live WHERE seq % 2 = 0 ORDER BY key LIMIT 25")
def legacy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next records to rewrite, of a table that holds both formats."""
    old = F.to_json(F.struct(F.array(F.lit(118)).alias("value"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-01T00:00:00Z").alias("updated_at"))).cast("binary")
    raw = live_of(spark, sf_dir).select("key", F.when(F.col("seq") % 2 == 0, old).otherwise(codec.upgrade_records(old)).alias("raw"))
    return codec.legacy_batch(raw, 25).select("key")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live key set, in key order."""
    return live_of(prepare(spark), sf_dir).select("key", "value", "created_at", "ttl_secs").orderBy("key")



