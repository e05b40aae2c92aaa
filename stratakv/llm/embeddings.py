"""Near-duplicate vectors by NN-descent.

1. Equal vectors are one class with a multiplicity; from here on classes stand for their vectors. A class's number
   is a hash of its vector, so classes with one least id stay apart; components are labelled with the least id.
2. First graph: classes that agree on the signs of some random hyperplanes are a leaf of a table. All pairs of a
   leaf are compared (a large one in pairs of blocks), and there are so many tables that a pair at the threshold
   shares no leaf with probability ``MISS`` at most, whatever the size. Each class keeps its ``LIST`` best neighbours
   with cosine over a floor.
3. NN-descent: neighbours of neighbours (in both directions) are joined and compared, lists keep the best, until
   no list changes but those full of links (step 4 takes these). The floor is the cosine of twice the link angle: if v links to a neighbour of u that
   links to u, cosine(u, v) is not below it (the triangle inequality of angles), so nothing that a path of two
   links reaches is cut off.
4. A list that is full of links is saturated: it may hide more. The lists of its component are doubled and descended
   again, and so on until none is full. Where a component has no more than ``WORTH`` times the square of a list's size
   in members, comparing all of them costs less than joining such lists: its lists are enlarged to the whole component,
   in pairs of blocks of at most ``BLOCK`` vectors, each pair a task's group of its own, from which counts and a spanning
   forest of links come out, not the links one by one. So work follows the links, or a bounded number a vector.
5. Audit: vectors chosen by a hash are compared with every row by brute force, in blocks: ``AUDIT`` of enlarged
   components, ``AUDIT`` of others with links and ``UNLINKED`` of those without. Each vector that has links counts
   once, however many it has. While the mean recall of the first or of the other vectors is under ``RECALL``,
   further tables of hyperplanes are added (up to ``ROUNDS``), then it fails. Where no vector of the sample has a link,
   recall is unmeasured, and what holds is the bound of step 2.

Links are exact: cosine in double precision at least the threshold; none below it is kept.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different length link with nothing; rows that repeat an id count as vectors of their own with that id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import materialize, prepare
from stratakv.llm.components import components

THRESHOLD = 0.95
#: Classes of a leaf aimed at, most classes of a block of a larger one, neighbours in a list.
AIM, LEAF, LIST = 256, 512, 8
#: Probability that a pair at the threshold shares no leaf of a round's tables.
MISS = 1e-3
#: Lists only get better, so NN-descent ends; iterations after which something is wrong.
ITERATIONS = 60
BLOCK, WORTH = 512, 64
AUDIT, UNLINKED, RECALL, ROUNDS = 512, 2048, 0.98, 3


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, stored as bytes of doubles, as rows of length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec binary, dim``: the doubles of each row; null where the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = None if x is None or not len(x) or any(c is None for c in x) else np.array(x, np.float64)
                # adding 0 makes -0 equal to 0
                out.append(None if v is None or not np.isfinite(v).all() or not v.any() else (v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([None if v is None else len(v) // 8 for v in out], pa.int32())], ["vec_id", "vec", "dim"])

    prepare(vectors.sparkSession)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary, dim int")


def code_bits(n: int) -> int:
    return max(1, min(24, math.ceil(math.log2(max(n, 2) / AIM))))


def table_count(n: int, threshold: float = THRESHOLD) -> int:
    """Tables of ``code_bits(n)`` hyperplanes that leave a pair at the threshold apart with probability ``MISS`` at most."""
    together = (1 - math.acos(threshold) / math.pi) ** code_bits(n)
    return 1 if together >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-together))


def leaf_links(classes: DataFrame, n: int, tables: range, floor: float, size: int = LIST) -> DataFrame:
    """``u, v, sim``: best neighbours of each class inside the leaves of the given tables."""
    bits = code_bits(n)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = unit(part.column(1))
                for t in tables:
                    planes = np.random.default_rng([t, d]).standard_normal((d, bits))
                    c = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(x), d), pa.int32()), pa.array(np.full(len(x), t), pa.int32()), pa.array(c)], ["id", "dim", "t", "code"])

    def compare(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), unit(group.column("vec").combine_chunks())
        own = group.column("own").to_numpy()
        cosine = x @ x.T
        if group.column("i")[0] != group.column("j")[0]:  # pairs inside one block belong to the group of that block
            cosine[own[:, None] == own[None, :]] = -2
        np.fill_diagonal(cosine, -2)
        k = min(size, len(ids) - 1)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        sim = np.take_along_axis(cosine, near, 1)
        good = sim >= floor
        return pa.table({"u": np.repeat(ids, near.shape[1])[good.ravel()], "v": ids[near][good], "sim": sim[good]})

    coded = materialize(classes.select("id", "vec", "dim").mapInArrow(code, "id long, dim int, t int, code long"))
    counts = materialize(coded.groupBy("dim", "t", "code").agg(F.count("*").alias("n")).where("n > 1"))
    # a leaf over the bound is dealt into blocks, of which all pairs are compared
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    leaves = coded.join(counts, ["dim", "t", "code"]).withColumn("own", F.pmod(F.xxhash64("id", "t"), blocks).cast("int"))
    leaves = leaves.select("id", "dim", "t", "code", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    leaves = leaves.select("id", "dim", "t", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return leaves.join(classes.select("id", "vec"), "id").groupBy("dim", "t", "code", "i", "j").applyInArrow(compare, "u long, v long, sim double")


def best(links: DataFrame, size: int) -> DataFrame:
    """The best ``size`` neighbours of each class; ``links`` has both directions, at most a few lists for each class."""
    rank = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return links.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= size).drop("r")


def with_cosine(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``u, v, sim`` of the pairs ``(u, v)`` with at least that cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = np.empty(batch.num_rows)
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x, y = (unit(batch.column(k).take(pa.array(at))) for k in (2, 3))
                sims[at] = np.einsum("ij,ij->i", x, y)
            keep = sims >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(sims[keep])], ["u", "v", "sim"])

    a = classes.select(F.col("id").alias("u"), F.col("vec").alias("x"), "dim")
    b = classes.select(F.col("id").alias("v"), F.col("vec").alias("y"), F.col("dim").alias("d"))
    return pairs.join(a, "u").join(b, "v").where("dim = d").select("u", "v", "x", "y", "dim").mapInArrow(run, "u long, v long, sim double")


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v", "sim").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def full_lists(graph: DataFrame, threshold: float, size: int = LIST) -> DataFrame:
    """``id`` of the classes whose lists are full of links."""
    return graph.groupBy("u").agg(F.count("*").alias("k"), F.min("sim").alias("low")).where((F.col("k") >= size) & (F.col("low") >= threshold)).select(F.col("u").alias("id"))


def descend(graph: DataFrame, classes: DataFrame, floor: float, size: int = LIST, threshold: float = THRESHOLD) -> DataFrame:
    """Neighbours-of-neighbours joins until the lists settle. ``graph``: materialised lists ``u, v, sim``."""
    if graph.isEmpty():
        return graph
    for _ in range(ITERATIONS):
        # lists are of a bounded size in both directions: the best ones that name a class, besides those it names
        around = materialize(best(_both(graph), 2 * size))
        # the lists are not symmetric (a hub need not list what lists it), so a path may exist from its greater end only
        ordered = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        via = around.select(F.col("v").alias("w"), "u").join(around.select(F.col("u").alias("w"), "v"), "w").where("u <> v").select(*ordered).distinct()
        fresh = via.join(around.select(*ordered).distinct(), ["u", "v"], "left_anti")
        found = materialize(with_cosine(fresh, classes, floor))
        new = materialize(best(around.unionByName(_both(found)), size))
        changed = new.join(graph.select("u", "v"), ["u", "v"], "left_anti")
        settled = changed.join(full_lists(new, threshold, size).withColumnRenamed("id", "u"), "u", "left_anti").isEmpty()
        graph = new
        if settled:
            return graph
    raise RuntimeError("neighbour lists did not settle")


def enlarged(component: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(counts (id, n), links (a, b))`` of all pairs inside each component ``(id, component)``, in blocks."""
    sizes = materialize(component.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = component.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = dealt.select("id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        ids, own, m = group.column("id").to_numpy(), group.column("own").to_numpy(), group.column("mult").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        x = unit(group.column("vec").combine_chunks())
        near = x @ x.T >= threshold
        if i != j:  # pairs inside one block belong to the group of that block
            near &= own[:, None] != own[None, :]
        np.fill_diagonal(near, False)
        n = (near * m[None, :]).sum(1)
        label = np.arange(len(ids))
        while True:  # least label of the linked ones, and of their labels, until nothing changes
            low = np.where(near, label[None, :], len(ids)).min(1, initial=len(ids))
            new = np.minimum(label, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.table({"id": ids, "n": n.astype(np.int64), "root": ids[label]})

    full = pairs.join(classes.select("id", "vec", "mult"), "id")
    out = materialize(full.groupBy("component", "i", "j").applyInArrow(compare, "id long, n long, root long"))
    return out.groupBy("id").agg(F.sum("n").alias("n")), out.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def audit(classes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT, unlinked: int = UNLINKED) -> float | None:
    """Mean recall of a class's links against brute force: the lower one of enlarged components and of all others.

    None if no vector of the sample has a link: nothing was measured.

    ``counts``: ``id, n, whole``, where ``whole`` says that ``n`` comes from an enlarged component. Classes without
    links have no recall; those that seem to have none are sampled apart, as few of them hold what was missed.
    """
    kind = F.when(F.coalesce("n", F.lit(0)) == 0, 0).when(F.col("whole"), 2).otherwise(1)
    known = materialize(classes.select("id", "vec", "dim").join(counts, "id", "left").select("id", "vec", "dim", F.coalesce("n", F.lit(0)).alias("n"), kind.alias("kind")))
    sizes = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    picked = pd.concat([known.where(F.col("kind") == k).orderBy(F.xxhash64("id", F.lit(50)), "id").limit(unlinked if k == 0 else sample).toPandas() for k in range(3)])
    by_dim = {d: (p["id"].to_numpy(), unit(pa.array(p["vec"]))) for d, p in picked.groupby("dim")}
    shared = classes.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = {d: np.zeros(len(own)) for d, (own, _) in shared.value.items()}
        for batch in batches:
            dims, ids, mult = batch.column(2).to_numpy(), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for d, (own, q) in shared.value.items():
                at = np.flatnonzero(dims == d)
                near = q @ unit(batch.column(1).take(pa.array(at))).T >= threshold if len(at) else np.zeros((len(own), 0), bool)
                near &= own[:, None] != ids[at][None, :]
                exact[d] += near.astype(np.float64) @ mult[at]
        for d, (own, _) in shared.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(exact[d].astype(np.int64))], ["id", "exact"])

    exact = classes.select("id", "vec", "dim", "mult").mapInArrow(run, "id long, exact long").groupBy("id").agg(F.sum("exact").alias("exact"))
    each = picked[["id", "n", "kind"]].merge(exact.toPandas(), on="id")
    each["linked"] = each["exact"] > 0
    each["recall"] = np.minimum(each["n"], each["exact"]) / np.maximum(each["exact"], 1)
    means = each.groupby("kind")[["linked", "recall"]].mean()

    def mean_recall(kinds: tuple[int, ...]) -> list[float]:
        held, got = (sum(sizes[k] * means.loc[k, x] for k in kinds if k in means.index) for x in ("linked", "recall"))
        return [float(got / held)] if held else []

    return min(mean_recall((2,)) + mean_recall((0, 1)), default=None)


def numbered(every: DataFrame) -> DataFrame:
    """``id, key, least, mult, vec, dim``: a row for each vector of ``every``; ``least`` is its least vec_id."""
    classes = every.where("vec is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    for seed in range(8):
        out = materialize(classes.select(F.xxhash64("key", F.lit(seed)).alias("id"), "*"))
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("class numbers collide")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    every = materialize(packed(vectors, id_col, vector_col).withColumn("key", F.sha2("vec", 256)))
    classes = numbered(every)
    floor = math.cos(min(math.pi, 2 * math.acos(threshold)))
    n, graph = classes.count(), None
    tables = table_count(n, threshold)
    for k in range(ROUNDS):
        leaves = leaf_links(classes, n, range(k * tables, (k + 1) * tables), floor)
        graph = materialize(best(_both(leaves if graph is None else leaves.unionByName(graph)), LIST))
        graph = descend(graph, classes, floor, LIST, threshold)
        graph, whole = lists_enlarged(graph, classes, floor, threshold)
        counts, pairs = _counts(graph, whole, classes, threshold)
        recall = audit(classes, counts, threshold)
        if recall is None or recall >= RECALL:
            break
    else:
        raise RuntimeError("the audit's recall stays too low")
    comp = components(pairs).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = materialize(classes.select("key", "id", "mult", "least").join(counts.select("id", "n"), "id", "left").join(comp, "id", "left").withColumn("root", F.coalesce("root", "id")))
    labels = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")))
    by_class = rooted.join(labels, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component")
    out = every.select("vec_id", "key").join(by_class, "key", "left")
    label = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.col("vec_id").eqNullSafe(label).alias("kept"))


def lists_enlarged(graph: DataFrame, classes: DataFrame, floor: float, threshold: float, worth: int = WORTH) -> tuple[DataFrame, DataFrame]:
    """``graph`` without lists that hide links, but for those of the components ``(id, component)`` that are to be compared whole."""
    size, settled, whole = LIST, None, None
    both = lambda x, y: y if x is None else x.unionByName(y)
    while True:
        pairs = graph.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        comp = materialize(components(pairs).select(F.col("node").alias("id"), "component"))
        hiding = materialize(comp.join(full_lists(graph, threshold, size), "id", "left_semi").select("component").distinct())
        inside = materialize(comp.join(hiding, "component", "left_semi"))
        large = materialize(inside.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > worth * size * size).select("component"))
        whole = both(whole, inside.join(large, "component", "left_anti").select("id", "component"))
        if large.isEmpty():
            return materialize(both(settled, graph)), materialize(whole)
        members = materialize(inside.join(large, "component", "left_semi").select("id"))
        settled = both(settled, graph.join(members.withColumnRenamed("id", "u"), "u", "left_anti"))
        own = graph.join(members.withColumnRenamed("id", "u"), "u", "left_semi").join(members.withColumnRenamed("id", "v"), "v", "left_semi")
        size *= 2
        graph = descend(materialize(best(_both(own), size)), materialize(classes.join(members, "id", "left_semi")), floor, size, threshold)


def _counts(graph: DataFrame, whole: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(id, n, whole)`` links of each class with multiplicity (``whole``: from a whole component), and links ``(a, b)`` that span all components."""
    links = materialize(_both(graph.where(F.col("sim") >= threshold)).select("u", "v").distinct())
    more, spanning = enlarged(whole, classes, threshold)
    plain = links.join(whole.select(F.col("id").alias("u")), "u", "left_anti").join(classes.select(F.col("id").alias("v"), "mult"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("mult").alias("n"))
    pairs = links.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return materialize(plain.withColumn("whole", F.lit(False)).unionByName(more.withColumn("whole", F.lit(True)))), pairs.unionByName(spanning)


#: The same rows from the cosines of all pairs.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
