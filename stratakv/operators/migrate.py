"""Migration of entries from disk to the object tier, by age or under space pressure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.functions.codec import object_key
from stratakv.operators.ttl import moment
from stratakv.sources.oplog import age_over


def candidates(entries: DataFrame, as_of: datetime | str, age_secs: int, limit: int, pressure: bool = False) -> DataFrame:
    """The first ``limit`` entries in key order that qualify, with ``reason``: age is named before space pressure."""
    old = age_over(F.col("created_at"), F.lit(age_secs), moment(as_of))
    reason = F.when(old, "age").when(F.lit(pressure), "space_pressure")
    return entries.withColumn("reason", reason).where(F.col("reason").isNotNull()).orderBy("key").limit(limit)


def to_objects(entries: DataFrame, prefix: str = "data/") -> DataFrame:
    """Entries as objects: the creation time is kept, the TTL is not."""
    return entries.select(F.concat(F.lit(prefix), object_key(F.col("key"))).alias("object_key"), "value", F.octet_length("value").cast("long").alias("size_bytes"), "created_at", F.col("key").alias("original_key"), F.lit("application/octet-stream").alias("content_type"))


def migrate(disk: DataFrame, objects: DataFrame, chosen: DataFrame, prefix: str = "data/") -> tuple[DataFrame, DataFrame]:
    """``(disk, objects)`` after the chosen entries moved; an object of the same key is replaced."""
    moved = to_objects(chosen, prefix)
    left = objects.join(moved.select("object_key"), "object_key", "left_anti")
    return disk.join(chosen.select("key"), "key", "left_anti"), left.unionByName(moved)
