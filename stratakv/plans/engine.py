"""The store as one object: batches of keys in, DataFrames out, and what its HTTP routes answer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions.codec import embed_text, object_key, packed
from stratakv.operators import migrate as moving
from stratakv.operators import tiers, ttl
from stratakv.operators.lru import Cache
from stratakv.operators.ring import Ring
from stratakv.plans.config import StoreConfig
from stratakv.session import materialize, prepare
from stratakv.sources.objects import Backend, MemoryBackend
from stratakv.sources.oplog import ENTRY
from stratakv.sources.versions import PackedTable

VERSION = "0.1.0"
MAX_BODY_BYTES = 64 << 20


class WrongShard(ValueError):
    """The key belongs to another shard."""


@dataclass
class Engine:
    """Disk entries in a versioned table, objects in a backend, a cache of keys on the driver (bounded by its limits).

    Values are stored compressed in both tiers, and the cache counts their compressed sizes; keys and values may be any bytes.

    Every time is given (``as_of``), so a run can be repeated. Writes are batches: one new segment of the table each.
    What a batch returns is written to the scratch folder first, as old segments go.
    """

    spark: SparkSession
    config: StoreConfig
    path: str
    objects: Backend | None = None
    cache: Cache = field(init=False)
    migrations: int = 0

    def __post_init__(self) -> None:
        prepare(self.spark)
        self.disk = PackedTable(self.spark, f"{self.path}/disk", ENTRY)
        self.objects = self.objects or MemoryBackend(self.spark)
        self.cache = Cache(self.config.memory_bytes, self.config.memory_entries)
        self.ring = Ring(self.config.total_shards, self.config.virtual_nodes)

    # -- batches -------------------------------------------------------------------------------------------

    def _object_rows(self) -> DataFrame:
        return self.objects.objects().select(F.col("original_key").alias("key"), "value", "created_at", F.col("size_bytes").alias("size"))

    def _tiers(self) -> dict[str, DataFrame]:
        lower = {"disk": self.disk.read(), "object": self._object_rows()}
        hot = self.spark.createDataFrame([(k,) for k in self.cache.held], "key string")
        # a cached key answers from memory, also after its entry moved to the object tier
        held = tiers.lookup(hot, lower).where("tier is not null").select("key", "value", "created_at")
        return {"memory": held} | lower

    def put_batch(self, rows: DataFrame, as_of: str) -> DataFrame:
        """``rows``: ``key, value`` and perhaps ``ttl_secs``, each key once (else the batch is refused). Returns ``key, previous, previous_created_at, previous_updated_at, previous_ttl_secs``: the entry that each one replaces, or nulls."""
        ttl_secs = F.col("ttl_secs").cast("long") if "ttl_secs" in rows.columns else F.lit(None).cast("long")
        now = ttl.moment(as_of)
        fresh = rows.select(F.col("key").cast("string").alias("key"), "value", now.alias("created_at"), now.alias("updated_at"), ttl_secs.alias("ttl_secs"))
        replaced = materialize(fresh.select("key").join(self._previous(), "key", "left"))
        self.disk.apply(upserts=fresh)
        return replaced

    def _previous(self) -> DataFrame:
        return self.disk.read().select("key", F.col("value").alias("previous"), *[F.col(c).alias(f"previous_{c}") for c in ("created_at", "updated_at", "ttl_secs")])

    def get_batch(self, keys: DataFrame) -> DataFrame:
        return tiers.lookup(keys, self._tiers())

    def contains_batch(self, keys: DataFrame) -> DataFrame:
        return tiers.contains(keys, self._tiers())

    def delete_batch(self, keys: DataFrame) -> DataFrame:
        """``key, deleted`` and the entry that was on disk, as in ``put_batch``; the keys go from every tier, the cache included."""
        marks = tiers.delete_everywhere(keys, {"disk": self.disk.read(), "object": self._object_rows()})[1]
        marks = materialize(marks.join(self._previous(), "key", "left"))
        self.disk.apply(deletes=marks.where("deleted"))
        self.objects.delete(keys.select(F.concat(F.lit(self.config.object_prefix), object_key(F.col("key"))).alias("object_key")))
        self._forget(marks.select("key"))
        return marks

    def expire(self, as_of: str) -> int:
        """Removes expired keys from all tiers; how many were found (on disk)."""
        gone = materialize(ttl.expired_keys(self.disk.read(), self.config.ttl_rules, as_of).select("key"))
        n = gone.count()
        if n:
            self.delete_batch(gone)
        return n

    def _forget(self, gone: DataFrame) -> None:
        held = self.spark.createDataFrame([(k,) for k in self.cache.held], "key string")
        for r in held.join(gone, "key", "left_semi").toLocalIterator():  # at most the cache's entries
            self.cache.delete(r.key)

    def usage_percent(self) -> float:
        return tiers.usage(self.disk.read(), self.config.disk_bytes).first().usage_percent

    def should_migrate(self) -> bool:
        return not self.config.cache_only and self.usage_percent() >= self.config.migration_threshold

    def migrate(self, as_of: str) -> int:
        """Moves one batch of candidates to the object tier. The cache keeps what it holds."""
        disk = self.disk.read()
        chosen = materialize(moving.candidates(disk, as_of, self.config.migration_age_secs, self.config.migration_batch, self.usage_percent() > 80.0))
        objects = moving.to_objects(chosen, self.config.object_prefix)
        n = chosen.count()
        if n:
            self.objects.put(objects)
            self.disk.apply(deletes=chosen)
            self.migrations += n
        return n

    def stats(self) -> dict:
        disk, objects = tiers.engine_stats(self.disk.read().limit(0), self.disk.read(), self._object_rows(), self.migrations).first(), self.cache
        total = objects.hits + objects.misses
        return {
            "memory_entries": len(objects.held), "memory_bytes": objects.size, "disk_entries": disk.disk_entries, "disk_bytes": disk.disk_bytes, "object_entries": disk.object_entries,
            "cache_hits": objects.hits, "cache_misses": objects.misses, "hit_rate": objects.hits / total if total else 0.0, "migrations_completed": self.migrations,
        }

    # -- single keys, as the routes see them ---------------------------------------------------------------

    def owned(self, key: str) -> bool:
        return self.config.total_shards <= 1 or self.ring.owns(key, self.config.shard_id)

    def get(self, key: str) -> dict | None:
        """``key, value, tier``; reads through the cache."""
        if self.cache.get(key):
            lower = {"disk": tiers.point_get(self.disk.read(), [key]), "object": self._object_rows()}
            row = tiers.lookup(self.spark.createDataFrame([(key,)], "key string"), lower).first()
            if row.tier is not None:
                return {"key": key, "value": row.value, "tier": "memory"}
            self.cache.delete(key)
            return None
        row = self.get_batch(self.spark.createDataFrame([(key,)], "key string")).first()
        if row is None or row.tier is None:
            return None
        self.cache.put(key, len(packed(row.value.encode())))
        return {"key": key, "value": row.value, "tier": row.tier}

    def handle(self, method: str, path: str, body: str = "", as_of: str = "1970-01-01 00:00:00") -> tuple[int, dict]:
        """``(status, JSON)`` of a request: the routes of the service without a socket."""
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "healthy", "version": VERSION}
        if (method, path) == ("GET", "/stats"):
            return 200, self.stats()
        if (method, path) == ("POST", "/admin/migrate"):
            n = self.migrate(as_of)
            return 200, {"migrated": n, "message": f"Migrated {n} entries"}
        if (method, path) == ("POST", "/admin/flush"):
            return 200, {"message": "Flushed"}
        if (method, path.partition("?")[0]) == ("GET", "/debug/profile"):
            return 200, {"plan": self.disk.read()._jdf.queryExecution().toString()}
        if not path.startswith("/kv/"):
            return 404, {"error": "not found", "code": "NOT_FOUND"}
        key = path[4:].removeprefix("/")
        missing = 404, {"error": f"Key not found: {key}", "code": "KEY_NOT_FOUND"}
        if method == "PUT":
            return self._put_route(key, body, as_of)
        if not self.owned(key):
            return missing
        one = self.spark.createDataFrame([(key,)], "key string")
        if method == "GET":
            found = self.get(key)
            return (200, found | {"value": json.loads(embed_text(found["value"]))}) if found else missing
        if method == "HEAD":
            return (404 if self.contains_batch(one).isEmpty() else 200), {}
        if method == "DELETE":
            in_cache = self.cache.delete(key)
            return 200, {"key": key, "deleted": self.delete_batch(one).first().deleted or in_cache}
        return 405, {"error": "method not allowed", "code": "METHOD_NOT_ALLOWED"}

    def _put_route(self, key: str, body: str, as_of: str) -> tuple[int, dict]:
        if len(body.encode()) > MAX_BODY_BYTES:
            return 413, {"error": "body too large", "code": "TOO_LARGE"}
        if not self.owned(key):
            return 421, {"error": f"Key {key} belongs to shard {self.ring.route(key)}", "code": "WRONG_SHARD"}
        try:
            d = json.loads(body)
            value, secs = d["value"], d.get("ttl")
            if not isinstance(value, str) or not (secs is None or (isinstance(secs, int) and not isinstance(secs, bool) and secs >= 0)):
                raise ValueError("value must be a string, ttl a number of seconds")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return 422, {"error": str(e), "code": "BAD_REQUEST"}
        self.put_batch(self.spark.createDataFrame([(key, value, secs)], "key string, value string, ttl_secs long"), as_of)
        self.cache.put(key, len(packed(value.encode())))
        return 201, {"key": key, "message": "Created"}


def route_request(key: str, addresses: list[str], virtual_nodes: int = 150) -> str | None:
    """The URL that a router forwards a key's request to; None if the shard has no address."""
    bare = key.removeprefix("/")
    shard = Ring(len(addresses), virtual_nodes).route(bare)
    return f"http://{addresses[shard]}/kv/{bare}" if shard < len(addresses) else None
