"""Consistent hashing: a ring of virtual nodes, routing, addresses and how evenly keys spread."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.functions.xxh3 import normalize_key, xxh3


@dataclass(frozen=True)
class Ring:
    """``shards`` x ``virtual_nodes`` points; a later point replaces an equal one."""

    shards: int
    virtual_nodes: int = 150

    @cached_property
    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted unsigned points and their shards."""
        at: dict[int, int] = {}
        for s in range(self.shards):
            for v in range(self.virtual_nodes):
                at[xxh3(f"shard-{s}-vn-{v}")] = s
        order = sorted(at)
        return np.array(order, np.uint64), np.array([at[p] for p in order], np.int32)

    def route_hashes(self, hashes: np.ndarray) -> np.ndarray:
        """The shard of the first point at or after each hash, wrapping to the first; 0 on an empty ring."""
        points, shards = self.points
        if not len(points):
            return np.zeros(len(hashes), np.int32)
        return shards[np.searchsorted(points, hashes, side="left") % len(points)]

    def route(self, key: str) -> int:
        """The shard of one key, on the driver: a literal key can so be pruned to its partition."""
        return int(self.route_hashes(np.array([xxh3(key)], np.uint64))[0])

    def owns(self, key: str, shard: int) -> bool:
        return self.route(key) == shard

    def shard_of(self, key: Column) -> Column:
        """Vectorised routing; the ring (a few numbers for each virtual node) travels with the function."""
        ring = self

        @F.pandas_udf(T.IntegerType())
        def route(keys: pd.Series) -> pd.Series:
            return pd.Series(ring.route_hashes(np.array([xxh3(k or "") for k in keys], np.uint64)))

        return route(normalize_key(key))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``point decimal(20,0), shard_id``."""
        points, shards = self.points
        rows = [(str(p), int(s)) for p, s in zip(points.tolist(), shards.tolist(), strict=True)]
        return spark.createDataFrame(rows, "point string, shard_id int").select(F.col("point").cast("decimal(20,0)").alias("point"), "shard_id")

    def distribution(self, spark: SparkSession) -> DataFrame:
        """``shard_id, points, percent``: the share of ring points, shards without points included."""
        counts = self.frame(spark).groupBy("shard_id").agg(F.count("*").alias("points"))
        total = len(self.points[0])
        every = spark.range(self.shards if total else 0).select(F.col("id").cast("int").alias("shard_id"))
        n = F.coalesce("points", F.lit(0)).cast("long")
        return every.join(counts, "shard_id", "left").select("shard_id", n.alias("points"), (n * 100.0 / F.lit(max(total, 1))).alias("percent"))

    def simulate(self, spark: SparkSession, n: int) -> DataFrame:
        """``shard_id, n_keys``: how the keys ``test-key-0`` ... spread."""
        keys = spark.range(n).select(F.concat(F.lit("test-key-"), F.col("id").cast("string")).alias("key"))
        counts = keys.select(self.shard_of(F.col("key")).alias("shard_id")).groupBy("shard_id").agg(F.count("*").alias("n_keys"))
        every = spark.range(self.shards).select(F.col("id").cast("int").alias("shard_id"))
        return every.join(counts, "shard_id", "left").select("shard_id", F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"))


def addresses(spark: SparkSession, config: list[tuple[int, str]]) -> DataFrame:
    """``shard_id, address``; of a repeated id the first stands."""
    first: dict[int, str] = {}
    for shard, address in config:
        first.setdefault(shard, address)
    return spark.createDataFrame(list(first.items()), "shard_id int, address string")


def cluster_configs(n: int, base_port: int, virtual_nodes: int = 150) -> list[dict]:
    """Configurations of a local cluster: every shard knows all addresses."""
    known = [(k, f"localhost:{base_port + k}") for k in range(n)]
    return [{"shard_id": k, "total_shards": n, "virtual_nodes": virtual_nodes, "addresses": known} for k in range(n)]


def key_addresses(keys: DataFrame, ring: Ring, known: DataFrame) -> DataFrame:
    """``key, shard_id, address``; null where the shard's address is unknown. ``known`` has a row for each shard."""
    return keys.withColumn("shard_id", ring.shard_of(F.col("key"))).join(F.broadcast(known), "shard_id", "left").select("key", "shard_id", "address")
