"""Lookups over tiers: the first tier that has a key wins; semi and anti joins for contains and delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers in the order in which they answer.
TIERS = ("memory", "disk", "object")


def stacked(tiers: dict[str, DataFrame]) -> DataFrame:
    """``key, value, created_at, tier, rank`` of all tiers."""
    parts = [df.select("key", "value", "created_at", F.lit(t).alias("tier"), F.lit(TIERS.index(t)).alias("rank")) for t, df in tiers.items()]
    return reduce(DataFrame.unionByName, parts)


def lookup(keys: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """``key, value, created_at, tier`` for every row of ``keys``; null value and tier where no tier has it.

    The tiers are filtered by the wanted keys and reduced by key once, instead of one outer join for each tier.
    """
    wanted = keys.select("key").distinct()
    hit = stacked(tiers).join(wanted, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("value", "created_at", "tier"), "rank").alias("hit"))
    return wanted.join(hit, "key", "left").select("key", "hit.value", "hit.created_at", "hit.tier")


def point_get(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a few literal keys: the filter reaches the scan."""
    return entries.where(F.col("key").isin(keys))


def contains(keys: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """The keys that some tier has; reads key columns only."""
    held = reduce(DataFrame.unionByName, [df.select("key") for df in tiers.values()])
    return keys.select("key").distinct().join(held, "key", "left_semi")


def delete_everywhere(keys: DataFrame, tiers: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tiers without the keys, and ``key, deleted`` with whether any tier had it."""
    gone = keys.select("key").distinct()
    left = {t: df.join(gone, "key", "left_anti") for t, df in tiers.items()}
    marked = contains(gone, tiers).withColumn("deleted", F.lit(True))
    return left, gone.join(marked, "key", "left").select("key", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def remove_batch(entries: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries without the keys, and one row ``removed`` with how many were there (repeated keys count once)."""
    gone = keys.select("key").distinct()
    return entries.join(gone, "key", "left_anti"), gone.join(entries, "key", "left_semi").agg(F.count("*").alias("removed"))


def promoted(found: DataFrame, memory: DataFrame) -> DataFrame:
    """The memory tier after a batch of reads: rows that lower tiers answered are copied into it."""
    fresh = found.where(F.col("tier").isin("disk", "object")).select("key", "value", "created_at")
    return memory.select("key", "value", "created_at").unionByName(fresh)


def _bytes(entries: DataFrame) -> Column:
    """The sum of the values' sizes; a ``size`` column spares the scan of the values."""
    size = F.col("size") if "size" in entries.columns else F.octet_length("value")
    return F.coalesce(F.sum(size), F.lit(0)).cast("long")


def usage(entries: DataFrame, max_bytes: int, threshold: float = 80.0, cache_only: bool = False) -> DataFrame:
    """``entries, bytes, usage_percent, migrate, pressure``: logical bytes of the values against the limit.

    The trigger holds from the threshold on (unless only caching); pressure only above 80 %.
    """
    sums = entries.agg(F.count("*").alias("entries"), _bytes(entries).alias("bytes"))
    percent = F.col("bytes") * 100.0 / F.lit(max_bytes) if max_bytes else F.lit(0.0)
    return sums.withColumn("usage_percent", percent).withColumn("migrate", (F.col("usage_percent") >= threshold) & F.lit(not cache_only)).withColumn("pressure", F.col("usage_percent") > 80.0)


def engine_stats(memory: DataFrame, disk: DataFrame, objects: DataFrame, migrations: int = 0) -> DataFrame:
    """One row of counters over the three tiers."""
    size = lambda df, n: df.agg(F.count("*").alias(f"{n}_entries"), _bytes(df).alias(f"{n}_bytes"))
    return size(memory, "memory").crossJoin(size(disk, "disk")).crossJoin(size(objects, "object")).withColumn("migrations_completed", F.lit(migrations).cast("long"))
