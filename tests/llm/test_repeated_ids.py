"""Documents that share an id and nothing else."""

import corpus_pipeline as p
from stratakv.llm import embeddings, minhash


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, c), (7, c), (8, b), (9, b + " more"), (10, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.near_duplicate_stage(spark, docs, "").collect()]
    # null ids are left alone; of the near copies of b one row stays, whichever id it has
    assert sorted(t for k, t in got if k == 7 and t in (a, c)) == [a, c]
    assert sum(t is not None and t.startswith(b) for _, t in got) == 1
    assert sorted(map(str, (t for k, t in got if k is None))) == [a, a] and (10, None) in got
    assert len(got) == 6


def test_near_duplicates_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    # five equal rows of one id and text, besides
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), *[(4, " ".join(f"c{k}" for k in range(30)))] * 5, (5, " ".join(f"c{k}" for k in range(31))), (None, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), *[(4, 4, True)] * 5, (5, 4, False)]


def test_links_of_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (7, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 1.0])]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 1, 7), (7, 1, 7)]
