"""Connected components of a link table, and joins that check a side's size before they broadcast it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import materialize

#: Most rows of a materialised side that is broadcast, when a row is one or two numbers (about 32 MB).
BROADCAST_ROWS = 1_000_000
MAX_ROUNDS = 60


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``rows`` rows, else as it is (the join then shuffles).

    ``side`` must be materialised and hold only a few numbers a row.
    """
    return F.broadcast(side) if side.count() <= rows else side


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``, a written table, for each node of ``links (a, b)``: the least node reachable.

    Alternating large-star and small-star steps: each node hands its larger, then its smaller neighbours to the
    least node it sees. Every step is a minimum by node (combined before the shuffle), written, and an equi-join
    with it, whose skewed partitions can be split; so a node with very many links is never gathered in one task.
    The number of steps grows with the logarithm of the longest chain. The table of minima also counts each node's
    neighbours on either side, which tells whether only stars are left; it is the result then, without another step.
    Self-links and repeated links are harmless.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        # large star: u's neighbours above u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count("*").alias("n"))
        least = materialize(seen.select("u", F.least("u", "m").alias("m"), "below", "n"))
        if least.where("below > 0 and n > 1").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = materialize(both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its neighbours below u go to the least of these
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        handed = large.join(low, "u")
        edges = materialize(handed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    raise RuntimeError("components did not settle")
