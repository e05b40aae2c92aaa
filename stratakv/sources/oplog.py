"""Operation logs: the schema, the log made from the ``events`` table, latest-wins folds and previous values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()), T.StructField("ttl_secs", T.LongType())])
OPLOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ttl_secs", T.LongType()), T.StructField("source_replica", T.IntegerType())])

DAY = 86_400


def from_events(events: DataFrame) -> DataFrame:
    """One operation for each event: sign-ups and purchases put, errors delete, views and clicks get."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "put").when(kind == "error", "delete").otherwise("get")
    prefix = F.element_at(F.array(F.lit("app/"), F.lit("tmp/"), F.lit("keep/")), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(
        (F.col("event_id") + 1).alias("seq"), "ts", op.alias("op"), F.concat(prefix, F.col("user_id").cast("string")).alias("key"), F.when(op == "put", F.col("props")).alias("value"),
        F.when((op == "put") & (F.col("event_id") % 4 == 0), (F.col("event_id") % 7 + 1) * DAY).alias("ttl_secs"), (F.col("event_id") % 3).cast("int").alias("source_replica"),
    )


def writes(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin("put", "delete"))


def fold(log: DataFrame) -> DataFrame:
    """The last write of each key, deletions included: ``key, seq, op, value, ts, ttl_secs``.

    ``max_by`` is combined before the shuffle, so a key that is written very often moves once for each task.
    """
    last = writes(log).groupBy("key").agg(F.max_by(F.struct("seq", "op", "value", "ts", "ttl_secs"), "seq").alias("last"))
    return last.select("key", "last.*")


def live(log: DataFrame) -> DataFrame:
    """Live entries ``key, value, created_at, updated_at, ttl_secs, seq``: a put resets both times and the TTL."""
    return fold(log).where("op = 'put'").select("key", "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "ttl_secs", "seq")


def previous_values(log: DataFrame) -> DataFrame:
    """For each write the value that it replaces, or null: ``seq, key, op, value, previous``."""
    by_key = Window.partitionBy("key").orderBy("seq")
    # a delete has a null value, so the lag is null after it, as it is before the first put
    return writes(log).withColumn("previous", F.lag("value").over(by_key)).select("seq", "key", "op", "value", "previous")


def count_trail(log: DataFrame) -> DataFrame:
    """For each write the change it makes to the number of live keys: +1, 0 or -1."""
    by_key = Window.partitionBy("key").orderBy("seq")
    was = F.coalesce(F.lag("op").over(by_key) == "put", F.lit(False)).cast("int")
    return writes(log).withColumn("delta", (F.col("op") == "put").cast("int") - was).select("seq", "key", "op", "delta")


def age_over(column: Column, seconds: Column, as_of: Column) -> Column:
    """Whether more than ``seconds`` lie between ``column`` and ``as_of`` (strictly, to the microsecond)."""
    return (as_of - column) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
