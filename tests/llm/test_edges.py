"""What every corpus operator does with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratakv.llm import bpe, embeddings, licenses, lines, media, minhash, mixing, quality, suffixes, token_counts
from stratakv.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000
ROWS = [
    (1, "a plain text of some words that says one thing and another", "en", "s1", 58),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, "  \n\t\n ", "en", "s2", 6),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "a plain text of some words that says one thing and another", "en", "s3", 58),
    (7, "the same row", "en", "s3", 12),
    (7, "the same row", "en", "s3", 12),
    (None, "a text without an id", "en", "s1", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that an operator may use for itself."""
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *(F.lit("x").alias(c) for c in ("h", "r", "key", "score", "size", "row", "_size", "_kept", "_keys", "kind", "label")))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def run_all(spark, docs):
    return {
        "quality": quality.quality_scores(docs, labels(spark)),
        "lines": lines.dedup_lines(docs),
        "bpe": bpe.bpe_encode(docs, vocabulary("word_bpe_49k.json"), outputs=("ids", "decoded", "ids_sha256")),
        "licenses": licenses.scan(docs),
        "mixing": mixing.mix(docs),
        "copies": mixing.training_copies(docs),
        "minhash": minhash.near_duplicates(docs),
        "tokens": token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")),
        "suffixes": suffixes.remove_repeats(docs),
        "media": media.stored_features(media.store_texts(docs)),
    }


@pytest.fixture(scope="module")
def results(spark, docs):
    return {k: df.collect() for k, df in run_all(spark, docs).items()}


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_every_row_gives_a_row(results):
    for name, rows in results.items():
        if name != "copies":
            assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r[0]) for r in ROWS), name


def test_empty_tables(spark, docs):
    for name, df in run_all(spark, docs.limit(0)).items():
        assert df.count() == 0, name


def test_equal_texts_give_equal_values(results):
    for name in ("quality", "bpe", "licenses", "tokens", "media"):
        a, b = (by_id(results[name])[k].asDict() for k in (1, 6))
        for r in (a, b):
            r.pop("doc_id"), r.pop("held_out", None)
        assert a == b, name


def test_null_counts_as_empty(results):
    for name in ("quality", "bpe", "licenses", "tokens", "media", "suffixes"):
        a, b = (by_id(results[name])[k].asDict() for k in (2, 3))
        for r in (a, b):
            r.pop("doc_id"), r.pop("held_out", None)
        assert a == b, name


def test_defined_values(results):
    assert by_id(results["bpe"])[3].ids == [] and by_id(results["bpe"])[3].decoded == ""
    assert by_id(results["bpe"])[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id(results["tokens"])[3].n_tokens == 0 and by_id(results["tokens"])[5].over_limit
    m = by_id(results["minhash"])
    assert m[1].component_id == m[6].component_id == 1 and m[1].kept and not m[6].kept
    assert [m[k].component_id for k in (2, 3, 4)] == [2, 3, 4] and m[2].n_shingles == 0 and m[7].n_shingles == 1
    assert by_id(results["media"])[2].payload_bytes == 64
    s = by_id(results["suffixes"])
    assert s[5].n_removed == len(LONG) and s[1].n_removed == 0  # it repeats itself; the others are too short
    assert by_id(results["licenses"])[2].n_words == 0 and by_id(results["licenses"])[2].labels == ""
    assert by_id(results["mixing"])[2].taken == 0 and by_id(results["mixing"])[5].size == 40_000
    assert all(0 <= r.score <= 1 for r in results["quality"])
    k = by_id(results["lines"])
    assert k[4]._kept == "  \n\t\n " and k[2]._lines == 1 and k[2]._kept == "" and k[2].text is None


def test_without_labels_the_score_is_a_half(spark, docs):
    got = quality.quality_scores(docs, labels(spark).limit(0)).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}


def test_other_columns_pass_through(spark, docs):
    assert lines.dedup_lines(docs).columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "_kept"]
    assert mixing.training_copies(docs).columns == docs.columns
    texts = quality.keyed_text(docs)
    kept = quality.keep_good(docs, quality.fit(texts, labels(spark)), 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [0.0, 1.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0]), (12, [1e-300, 0.0]), (13, [1e300, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))
    got = embeddings.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    r = {x.vec_id: x for x in got if x.vec_id is not None}
    assert [r[k].component_id for k in (1, 2, 3, 12, 13)] == [1] * 5 and r[1].n_links == 4
    assert [r[k].n_links for k in (4, 5, 6, 7, 8, 9, 10)] == [0] * 7 and all(r[k].kept for k in (4, 5, 6, 7, 8, 9, 10))
    assert r[11].n_links == 1
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0
