"""Structured Streaming over operation logs: folding into a state table, caches as keyed state, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.operators.lru import Cache
from stratakv.session import materialize, scratch_dir
from stratakv.sources.versions import VersionedTable

STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("ttl_secs", T.LongType())])


def newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value", "ts", "ttl_secs"), "seq").alias("l"))
    return last.select("key", "l.*")


class Fold:
    """Latest-wins state in a segmented table: a micro-batch writes what it changes, not the whole state.

    The table's manifest notes the last epoch of each checkpoint in the same step. A new ``Fold`` on the same path goes
    on from there, and a batch that is delivered again is left out (its rows would change nothing anyway).
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.path = path or scratch_dir(spark)
        self.table = VersionedTable(spark, f"{self.path}/state", STATE)
        self.checkpoint = f"{self.path}/checkpoint"

    def state(self) -> DataFrame:
        return self.table.read()

    def apply(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.table.tags().get(self.checkpoint, -1):
            return
        fresh = newest(batch.where(F.col("op").isin("put", "delete")).select(*STATE.names))
        fresh = materialize(fresh)
        # an entry of the state stays if its sequence is higher
        known = self.state().join(fresh.select("key"), "key", "left_semi")
        self.table.apply(upserts=newest(known.unionByName(fresh)), tags={self.checkpoint: epoch})

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
        """Drains what is available and returns the live entries."""
        self.checkpoint = checkpoint or self.checkpoint
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.state().where("op = 'put'").select("key", "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "ttl_secs", "seq")


def cache_stream(stream: DataFrame, max_bytes: int, max_entries: int) -> DataFrame:
    """``shard, hits, misses, entries, bytes`` after each micro-batch: the cache of a shard is its state.

    ``stream``: ``shard, seq, op, key, size``. State is bounded by the cache's limits.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        cache = Cache(max_bytes, max_entries)
        if state.exists:
            keys, sizes, counts, cache.hits, cache.misses = state.get
            for k, s, c in zip(keys, sizes, counts, strict=True):
                cache.held[k], cache.counts[k] = s, c
            cache.size = sum(sizes)
        rows = pd.concat(list(batches)).sort_values("seq")
        for op, k, size in zip(rows.op, rows.key, rows["size"], strict=True):
            cache.step(op, k, int(size), False)
        state.update((list(cache.held), list(cache.held.values()), [cache.counts[k] for k in cache.held], cache.hits, cache.misses))
        yield pd.DataFrame({"shard": [key[0]], "hits": [cache.hits], "misses": [cache.misses], "entries": [len(cache.held)], "bytes": [cache.size]})

    return stream.groupBy("shard").applyInPandasWithState(update, "shard int, hits long, misses long, entries long, bytes long", "keys array<string>, sizes array<long>, counts array<long>, hits long, misses long", "update", "NoTimeout")


def operation_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """``window, op, n``: operations by event time; rows later than ``late`` are left out, closed windows come out once."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n"))
