"""Boilerplate lines: sketches far from the threshold, exact counts near it, one place kept."""

import time

from pyspark.sql import functions as F

from stratakv.llm import lines


def spread(spark, counts, repeats=1):
    """A document for each site and line: line k stands on ``counts[k]`` sites."""
    rows = [(k * 10_000 + s * repeats + r, f"line {k}\nown {k} {s} {r}", f"site {s}") for k, n in enumerate(counts) for s in range(n) for r in range(repeats)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_decisions_equal_exact_counts(spark):
    counts = [1, 60, 85, 98, 99, 100, 101, 103, 120, 140, 400, 900]
    got = lines.dedup_lines(spread(spark, counts), sites=100)
    removed = {r.k: r.n for r in got.where("_removed > 0").groupBy(F.floor(F.col("doc_id") / 10_000).alias("k")).agg(F.count("*").alias("n")).collect()}
    # one document keeps its line
    assert removed == {k: n - 1 for k, n in enumerate(counts) if n >= 100}
    kept = {r.doc_id: r._kept for r in got.where("doc_id % 10000 = 0").collect()}
    assert all(t.startswith("line ") for t in kept.values())


def test_many_documents_of_few_sites_are_no_boilerplate(spark):
    got = lines.dedup_lines(spread(spark, [5], repeats=60), sites=10)
    assert got.where("_removed > 0").count() == 0


def test_near_lines_only_are_counted_exactly(spark):
    keys = lines.line_keys(spread(spark, [50, 99, 100, 400]).where("doc_id >= 0"))
    keys.cache()
    est = keys.groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", lines.LG_K)).alias("e")).where("n > 1").collect()
    # the band around the threshold is eight standard errors wide: nothing outside it can be on the other side
    assert all((r.e > 125) <= (r.n >= 100) and (r.e < 75) <= (r.n < 100) for r in est)
    assert lines.boilerplate_keys(keys, 100).count() == 2


def test_blank_and_repeated_lines(spark):
    rows = [(s, "shared\n\n  \nshared\nmine %d" % s, f"s{s}") for s in range(12)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=10).collect()}
    assert got[0]._kept == "shared\n\n  \nmine 0" and got[0]._removed == 1
    assert got[5]._kept == "\n  \nmine 5" and got[5]._removed == 2 and got[5]._lines == 5


def test_many_lines_in_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"{k} is a line of boilerplate" for k in range(n))
        df = spark.createDataFrame([(s, f"own {s}\n{text}\n{text[:200]}", f"s{s}") for s in range(12)], "doc_id long, text string, source string").repartition(4)
        began = time.monotonic()
        got = {r.doc_id: r for r in lines.dedup_lines(df, sites=10).select("doc_id", "_lines", "_removed", F.length("_kept").alias("n")).collect()}
        assert got[0]._removed > 0 and got[5]._removed >= n and got[5].n < 100 and got[0].n >= len(text)
        return time.monotonic() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(8_000), 1)  # it was 25 times as long when work grew with the square


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, f"shared\nmine {s}", f"s{s}") for s in range(12)] + [(5, "shared\nfirst text", "t"), (5, "shared\nother text", "t"), (6, "shared\nlast", "u")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=10).collect()
    assert sorted(r._kept for r in got if r.doc_id is None) == sorted(f"mine {s}" for s in range(12))
    assert sorted(r._kept for r in got if r.doc_id == 5) == ["shared\nfirst text", "shared\nother text"]
    assert [r._kept for r in got if r.doc_id == 6] == ["last"]
