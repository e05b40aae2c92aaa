"""Removal of boilerplate lines that spread over many sites, with DataFrame functions only.

Every line is hashed (128 bits). For each hash a HyperLogLog sketch of its sites is merged by aggregation, map-side
first, so a line that stands in a third of all documents never gathers in one task. Hashes whose estimate is
within ``MARGIN`` of the threshold (eight standard errors) get an exact distinct count; those clearly above it are
boilerplate, those clearly below are not. A boilerplate line stays in the document of least id that has it, at its
first place there, and goes everywhere else. Blank lines always stay.

Rows are told apart by their id and a 128-bit hash of the text, and lines by their places in it. What goes from a row is
a list of places; hash sets of places, never a search for each line, so work is linear in the lines of a document.

Defined results: a null text counts as one empty line; a null site is a site of its own; rows that repeat an id
are treated alike (all of them keep what the least id keeps), as are rows without an id; an empty table gives an empty
result; other columns are passed through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import materialize, prepare

#: Distinct sites from which a line is boilerplate, and the band around it that is counted exactly.
SITES, MARGIN = 10, 0.25
#: 2**LG_K registers: a relative standard error of 3 %.
LG_K = 10
BLANK = "^[ \t\r\x0b\x0c]*$"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


#: What tells rows apart: rows that agree on all three have the same lines.
ROW = ("doc_id", "t1", "t2")


def _row(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``doc_id, t1, t2, site, pos, h1, h2``: place (from 0) and key of each line that is not blank."""
    site = F.coalesce(F.xxhash64(F.when(F.col(f"`{site_col}`").isNotNull(), F.col(f"`{site_col}`"))), F.lit(0)).alias("site")
    # hashes first: above the generator they would be worked out for each line
    own = docs.select(*_row(id_col, text_col), site, _split(F.col(f"`{text_col}`")).alias("lines"))
    each = own.select(*ROW, "site", F.posexplode("lines").alias("pos", "line"))
    return each.where(~F.col("line").rlike(BLANK)).select(*ROW, "site", "pos", _key(F.col("line")).alias("k")).select(*ROW, "site", "pos", "k.h1", "k.h2")


def boilerplate_keys(keys: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """``h1, h2, first_doc`` of the lines that stand on at least ``sites`` distinct sites. ``keys`` is materialised."""
    sketched = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    # a line can't be on more sites than it has occurrences: an exact bound that spares most estimates
    estimated = materialize(sketched.where(F.col("n") >= sites).select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("est")).where(F.col("est") >= sites * (1 - margin)))
    clear = estimated.where(F.col("est") > sites * (1 + margin)).select("h1", "h2", "first_doc")
    near = estimated.where(F.col("est") <= sites * (1 + margin)).select("h1", "h2", "first_doc")
    pairs = keys.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return clear.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def places_gone(keys: DataFrame, boiler: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, gone array<int>``: places of the lines that go from a row, at most as many as it has lines."""
    here = keys.join(boiler, ["h1", "h2"]).select(*ROW, "h1", "h2", "pos", F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("first"))
    by_line = here.groupBy(*ROW, "h1", "h2", "first").agg(F.collect_set("pos").alias("at"))
    # the document of least id keeps the line's first place
    goes = F.when(F.col("first"), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))
    return by_line.select(*ROW, goes.alias("at")).groupBy(*ROW).agg(F.flatten(F.collect_list("at")).alias("gone"))


def dedup_lines(docs: DataFrame, sites: int = SITES, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and ``_kept`` (the text without boilerplate), ``_lines``, ``_removed``.

    The three names are taken from clashing columns of ``docs``, should there be any.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("_kept", "_lines", "_removed", "_gone", "_split", "_id", "_t1", "_t2", "_i1", "_i2")
    keys = materialize(line_keys(docs, id_col, text_col, site_col))
    boiler = materialize(boilerplate_keys(keys, sites, margin))
    gone = places_gone(keys, boiler).withColumnsRenamed({"doc_id": "_id", "t1": "_i1", "t2": "_i2", "gone": "_gone"})
    _, t1, t2 = _row(id_col, text_col)
    own = docs.withColumn("_t1", t1).withColumn("_t2", t2)
    same = own[f"`{id_col}`"].eqNullSafe(gone["_id"]) & (own["_t1"] == gone["_i1"]) & (own["_t2"] == gone["_i2"])
    joined = own.join(gone, same, "left").drop("_id", "_i1", "_i2", "_t1", "_t2")
    # a generator of one row: the lines are a column from here on, not an expression that is worked out for each place
    split = joined.withColumn("_split", F.explode(F.array(_split(F.col(f"`{text_col}`")))))
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))
    stay = F.transform(places, lambda i: F.element_at("_split", i + 1))
    kept = F.when(F.col("_gone").isNull() | (F.size("_gone") == 0), F.col(f"`{text_col}`")).otherwise(F.array_join(stay, "\n"))
    out = split.withColumn("_kept", F.coalesce(kept, F.lit(""))).withColumn("_lines", F.size("_split"))
    return out.withColumn("_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_gone", "_split")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '<null>') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, site, unnest(lines) AS line FROM d),
b AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE NOT regexp_full_match(line, '[ \\t\\r\\x0b\\x0c]*') GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT doc_id, list(DISTINCT line) AS gone, list(DISTINCT line) FILTER (WHERE doc_id = first_doc) AS firsts FROM l JOIN b USING (line) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(lines) AS n_lines, list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), x) OR (list_contains(coalesce(firsts, []), x) AND list_position(lines, x) = i)) AS kept FROM d LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""
