"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating; together they share all words by weight.
No source gives more than ``REPEATS`` times its own words; what is over is reshared by weight among the others. That
water level is found in one ordered pass over the sources (one row each, not one for each document).

Curriculum: over training time t from 0 to 1, source s is drawn at the rate target * (1 + a (2t - 1)), a from its
weight (``SLOPES``). Its integral D(t) = target (t + a (t*t - t)) is the demand up to t, all of the target at t = 1.
The words of a source lie in a fixed order (by a hash of id and text); a document whose words begin at x is due at the t
with D(t) = x, which is a root of a quadratic. Sorting by range on t gives the training order.

Running sums are taken in two levels (hash buckets of a source, then within a bucket), so a source with a third of
all rows is spread over ``16**HEX`` buckets and never meets in one task. Sums over the sources themselves are taken
over ranges of sources, then within a range, so millions of sources don't meet in one task either.

Defined results: null texts have size 0; null sources are the last source; a source without words has target 0; rows
that repeat an id are documents of their own; an empty table gives an empty result; other columns pass through
``schedule`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import materialize, prepare
from stratakv.llm.components import small_enough

REPEATS, HEX = 3, 3
#: Change of the drawing rate over time for sources of weight 1, 2 and 3.
SLOPES = (-0.5, 0.0, 0.5)
#: Most (source, bucket) rows that are broadcast (about 20 MB); with more sources the join shuffles.
BROADCAST_BUCKETS = 200_000
SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)).cast("long")


def _running(rows: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """``rows`` (written) with the sum of each named column over the rows before, in the total order of the columns ``order``.

    Rows are sorted by range; a row's sum is that of the ranges before (one row for each range) and that within its own.
    """
    spark = rows.sparkSession
    columns = [F.col(c).asc_nulls_last() for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *columns).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(ranges), F.lit(0)).alias(f"_{name}") for name in sums))
    both = placed.join(F.broadcast(bases), "_range")  # as many rows as ranges
    return both.select(*rows.columns, *((F.col(f"_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from rows ``source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = _running(totals, ["source"], place="one").withColumn("weight", (F.col("place") % 3 + 1).cast("int"))
    ratio = ranked.withColumn("cap", REPEATS * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight")).select("source", "source_size", "weight", "cap", "ratio")
    # the water level in order of cap by weight: what the sources before, filled up, leave to the others
    level = materialize(_running(ratio, ["ratio", "source"], caps="cap", weights="weight"))
    every = level.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    left = level.crossJoin(F.broadcast(every)).withColumn("level", (F.col("all_size") - F.col("caps")).cast("double") / (F.col("all_weight") - F.col("weights")))
    free = left.withColumn("capped", F.col("ratio") <= F.col("level"))
    first = free.where("not capped").agg(F.min(F.struct("ratio", F.coalesce("source", F.lit("")), "level"))["level"].alias("open"))  # one row
    return free.crossJoin(F.broadcast(first)).select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def order_hash(id_column: Column, text: Column) -> Column:
    """What orders the rows of a source: rows that share an id, or have none, are spread by their texts."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, order: Column | None = None, taken_only: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``_size, _source_size, _target, _slope, _begin`` (words of its source before it).

    ``size, order``: words and ``order_hash`` of each row, where they are known already; ``taken_only``: may leave out rows that the mix takes
    no words of, before their texts are moved.
    """
    names = {"_size", "_source_size", "_target", "_slope", "_begin", "_hash", "_bucket", "_before"}
    own = docs.drop(*names).withColumn("_size", word_count(F.col(f"`{text_col}`")) if size is None else size).withColumn("_hash", order_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")) if order is None else order).withColumn("_bucket", F.substring("_hash", 1, HEX))
    narrow = materialize(own.select(F.col(f"`{source_col}`").alias("source"), F.col("_size").alias("size"), F.col("_bucket").alias("bucket")).groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(narrow)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = narrow.withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0))).select("source", "bucket", "_before")
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), F.col("weight"))
    both = materialize(before.join(targets, before["source"].eqNullSafe(targets["source"])).select(before["source"].alias("_s"), F.col("bucket").alias("_b"), "_before", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), slope.alias("_slope")))
    both = small_enough(both, BROADCAST_BUCKETS)
    joined = own.join(both, own[f"`{source_col}`"].eqNullSafe(both["_s"]) & (own["_bucket"] == both["_b"])).drop("_s", "_b")
    if taken_only:  # whole buckets that the last pass over their source does not reach
        joined = joined.where((_passes() > 0) | (F.col("_before") < F.col("_target")))
    inside = Window.partitionBy(F.col(f"`{source_col}`"), "_bucket").orderBy("_hash", F.col(f"`{id_col}`"), "_size").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("_begin", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_hash", "_bucket", "_before")


def _passes() -> Column:
    return F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))


def taken_words() -> Column:
    """Whole passes over the source, and of the last one what is left, up to the document's own words."""
    passes = _passes()
    rest = F.col("_target") - passes * F.col("_source_size") - F.col("_begin")
    return (passes * F.col("_size") + F.least(F.greatest(F.floor(rest), F.lit(0)), F.col("_size"))).cast("long")


def due(begin: Column) -> Column:
    """Training time at which the source's demand reaches ``begin`` words: the root of a t t + (1 - a) t = begin / target."""
    y = F.least(begin / F.col("_target"), F.lit(1.0))
    b = 1 - F.col("_slope")
    return 2 * y / (b + F.sqrt(b * b + 4 * F.col("_slope") * y))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_position`` in the order of training (not taken ones last)."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    sized = materialize(own.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("order")))
    # sizes are known from here on, so the schedule runs over narrow rows
    plan = schedule(sized, source_col="source", size=F.col("size"), order=F.col("order")).withColumn("taken", taken_words())
    placed = plan.withColumn("at", F.when(F.col("taken") > 0, due(F.col("_begin"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, F.col("at").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("at").asc_nulls_last(), "doc_id")
    # rows are sorted by the exact position, which is rounded only as a column
    return ordered.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "taken", F.round("at", 6).alias("first_position"))


def training_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as trained on: each row as often as the mix takes it (to the nearest whole copy), in training order."""
    prepare(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plan = schedule(docs, id_col, text_col, source_col, taken_only=True).withColumn("_taken", taken_words())
    copies = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int")
    each = plan.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    placed = each.withColumn("_at", due(F.col("_begin") + F.col("_copy") * F.col("_source_size")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "_at", F.col(f"`{id_col}`")).sortWithinPartitions("_at", F.col(f"`{id_col}`")).select(*columns)


ORACLE = """
WITH d AS (SELECT doc_id, source, md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM t),
v AS (SELECT *, (all_size - coalesce(sum(cap) OVER p, 0))::DOUBLE / (all_weight - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, ratio <= level AS capped, (SELECT arg_min(level, (ratio, coalesce(source, ''))) FROM v WHERE NOT ratio <= level) AS open FROM v),
g AS (SELECT source, source_size, weight, CASE WHEN capped THEN cap::DOUBLE ELSE open * weight END AS target, (weight - 2) * 0.5::DOUBLE AS a FROM o),
c AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM d),
x AS (SELECT c.*, g.source_size, g.target, g.a, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS passes FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, (passes * size + least(greatest(floor(target - passes * source_size - b), 0), size))::BIGINT AS taken FROM x)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(2 * least(b / target, 1.0::DOUBLE) / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * least(b / target, 1.0::DOUBLE))), 6) END AS first_position FROM y
"""
