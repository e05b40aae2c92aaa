"""Recall of vector links where groups are small, leaves large, or ids repeat."""

import numpy as np
import pytest

from stratakv.llm import embeddings
from stratakv.llm.common import materialize, prepare


def vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


def as_classes(spark, x, ids=None):
    prepare(spark)
    rows = [(int(k), np.asarray(v, np.float64).tobytes(), len(v), 1) for k, v in zip(ids or range(len(x)), x, strict=True)]
    return materialize(spark.createDataFrame(rows, "id long, vec binary, dim int, mult long"))


def test_pairs_of_a_large_leaf_all_meet(spark, monkeypatch):
    r = np.random.default_rng(1)
    # a cone of vectors over no threshold with each other, but for 300 pairs, and leaves of many blocks
    x = (12 * np.eye(48)[0] + r.standard_normal((300, 48))).repeat(2, 0) + 0.3 * r.standard_normal((600, 48))
    monkeypatch.setattr(embeddings, "LEAF", 32)
    classes = as_classes(spark, x)
    got = {(v.u, v.v) for v in embeddings.leaf_links(classes, 600, range(8), 0.94).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(k, k + 1) for k in range(0, 600, 2) if u[k] @ u[k + 1] >= 0.95]
    assert len(pairs) > 250
    assert np.mean([p in got for p in pairs]) > 0.995


@pytest.mark.parametrize("n", [100, 2_000, 51_282, 10**6, 10**7, 10**8])
def test_isolated_pairs_share_a_leaf_at_every_size(n):
    together = (1 - np.arccos(embeddings.THRESHOLD) / np.pi) ** embeddings.code_bits(n)
    assert (1 - together) ** embeddings.table_count(n) <= embeddings.MISS


def test_audit_weighs_vectors_not_links(spark):
    r = np.random.default_rng(2)
    clique, pairs = np.eye(16)[0] + 0.01 * r.standard_normal((100, 16)), r.standard_normal((30, 16)).repeat(2, 0) + 0.01 * r.standard_normal((60, 16))
    classes = as_classes(spark, np.concatenate([clique, pairs]))
    rows = [(k, 99, True) for k in range(100)]
    schema = "id long, n long, whole boolean"
    # every link of the pairs is missed, 60 of 9,960
    assert embeddings.audit(classes, spark.createDataFrame(rows, schema), 0.95) < embeddings.RECALL
    unlinked = as_classes(spark, r.standard_normal((200, 64)))
    assert embeddings.audit(unlinked, spark.createDataFrame([], schema), 0.95) is None  # unmeasured, not perfect
    assert embeddings.audit(classes, spark.createDataFrame(rows + [(k, 1, False) for k in range(100, 160)], schema), 0.95) == 1


@pytest.mark.parametrize("outer", [0, 9])
def test_paths_are_joined_whatever_the_order_of_ids(spark, outer):
    # 5 is a hub: it lists 1 and 2, not the outer vector that lists it; 1 is the outer vector's best neighbour
    degrees = {outer: 0, 1: 6, 5: 8, 2: 9}
    x = [[np.cos(np.radians(a)), np.sin(np.radians(a))] for a in degrees.values()]
    classes = as_classes(spark, x, list(degrees))
    sim = lambda a, b: float(np.cos(np.radians(degrees[a] - degrees[b])))
    lists = [(a, b, sim(a, b)) for a, b in ((outer, 5), (1, 5), (2, 5), (5, 2))]
    graph = materialize(spark.createDataFrame(lists, "u long, v long, sim double"))
    got = {(r.u, r.v) for r in embeddings.descend(graph, classes, 0.8, size=1).collect()}
    assert (outer, 1) in got


def test_vectors_of_one_id_are_classes_of_their_own(spark):
    a, b, near_b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(7, a), (7, b), (8, a), (9, b), (10, near_b)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(7, 1, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 2, 7, False), (10, 2, 7, False)]


def test_lists_double_until_none_is_full(spark):
    # a long path of vectors that link to some 20 of their neighbours on it, far more members than a list has places
    r = np.random.default_rng(5)
    x = [r.standard_normal(32)]
    for _ in range(499):
        v = x[-1] / np.linalg.norm(x[-1]) + 0.018 * r.standard_normal(32)
        x.append(v)
    x = np.array(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= embeddings.THRESHOLD
    np.fill_diagonal(near, False)
    classes = as_classes(spark, x)
    floor = np.cos(2 * np.arccos(embeddings.THRESHOLD))
    start = embeddings._both(embeddings.leaf_links(classes, len(x), range(embeddings.table_count(len(x))), floor))
    graph = embeddings.descend(materialize(embeddings.best(start, embeddings.LIST)), classes, floor)
    graph, whole = embeddings.lists_enlarged(graph, classes, floor, embeddings.THRESHOLD, worth=0.05)
    assert near.sum(1).max() > 2 * embeddings.LIST
    assert whole.count() == 0  # no component was compared whole
    counts, _ = embeddings._counts(graph, whole, classes, embeddings.THRESHOLD)
    got = {r.id: r.n for r in counts.collect()}
    assert np.mean([got.get(k, 0) == n for k, n in enumerate(near.sum(1).tolist())]) > 0.99
