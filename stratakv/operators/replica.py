"""Replication logs: reading on, merging, acknowledging, trimming, lag and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakv.session import materialize

#: Entries behind from which a replica isn't healthy.
MAX_LAG = 1000


def numbered(log: DataFrame) -> DataFrame:
    """Writes only; their ``seq`` orders them. (Gets are not replicated, nor is the TTL.)"""
    return log.where(F.col("op").isin("put", "delete")).select("seq", "op", "key", "value", "ts", "source_replica")


def sequenced(operations: DataFrame, *order: str) -> DataFrame:
    """Rows with a dense ``seq`` from 1 in the given total order.

    A window over all rows would sort them in one task. Here they are sorted by range, numbered inside each
    partition, and shifted by the sizes of the partitions before it (one row for each partition).
    """
    n = int(operations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partitions are told apart by what was written, so they are the same when read again
    placed = materialize(operations.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_at", inside).join(F.broadcast(sizes), "_part").withColumn("seq", (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def drained(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries handed over, what is pending afterwards)``: all, then none."""
    return pending, pending.limit(0)


def entries_since(log: DataFrame, since: int, batch: int) -> DataFrame:
    """The next ``batch`` entries after ``since``, in order."""
    return log.where(F.col("seq") > since).orderBy("seq").limit(batch)


def trimmed(log: DataFrame, max_entries: int) -> DataFrame:
    """The newest ``max_entries`` entries. The cut is one number, found by a bounded top list."""
    if max_entries <= 0:
        return log.limit(0)
    cut = log.select("seq").orderBy(F.desc("seq")).limit(max_entries).agg(F.min("seq").alias("cut"))
    return log.join(F.broadcast(cut), F.col("seq") >= F.col("cut")).drop("cut")


def merged(pending: DataFrame, received: DataFrame) -> DataFrame:
    """Pending entries in order of sequence, then arrival; repeated and missing sequences stay as they are."""
    both = pending.withColumn("arrival", F.lit(0)).unionByName(received.withColumn("arrival", F.lit(1)))
    return both.orderBy("seq", "arrival")


def highest_sequence(pending: DataFrame, local: int) -> DataFrame:
    """``sequence``: the highest pending one; the local one if nothing is pending."""
    return pending.agg(F.coalesce(F.max("seq"), F.lit(local)).cast("long").alias("sequence"))


def peer_states(peers: DataFrame, acks: DataFrame) -> DataFrame:
    """``replica_id, last_acked_sequence, is_online`` after ``acks (ack_order, replica_id, seq, online)``.

    The last acknowledgement counts, even if it goes back; one of an unknown peer is ignored; one that marks a peer
    offline (``online`` false) leaves its sequence. Peers start at 0, offline.
    """
    last = acks.groupBy("replica_id").agg(F.max_by(F.when(F.col("online"), F.col("seq")), F.when(F.col("online"), F.col("ack_order"))).alias("seq"), F.max_by("online", "ack_order").alias("online"))
    return peers.select("replica_id").join(last, "replica_id", "left").select("replica_id", F.coalesce("seq", F.lit(0)).cast("long").alias("last_acked_sequence"), F.coalesce("online", F.lit(False)).alias("is_online"))


def min_acked(peers: DataFrame) -> DataFrame:
    return peers.agg(F.coalesce(F.min("last_acked_sequence"), F.lit(0)).cast("long").alias("min_acked"))


def stats(log: DataFrame, peers: DataFrame) -> DataFrame:
    """One row: sequence, log size, peers, online peers, lag (0 without peers), health."""
    own = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("current_sequence"), F.count("*").alias("log_size"))
    others = peers.agg(F.count("*").alias("peers"), F.count_if("is_online").alias("online"), F.min("last_acked_sequence").alias("least"))
    lag = F.when(F.col("peers") == 0, F.lit(0)).otherwise(F.greatest(F.col("current_sequence") - F.col("least"), F.lit(0))).cast("long")
    row = own.crossJoin(others).withColumn("max_lag", lag)  # one row each
    return row.select("current_sequence", "log_size", "peers", "online", "max_lag", ((F.col("online") == F.col("peers")) & (F.col("max_lag") < MAX_LAG)).alias("healthy"))


def truncated(log: DataFrame, peers: DataFrame) -> DataFrame:
    """Without the entries that every peer has acknowledged; without peers, all."""
    return log.join(F.broadcast(min_acked(peers)), F.col("seq") > F.col("min_acked")).drop("min_acked")
