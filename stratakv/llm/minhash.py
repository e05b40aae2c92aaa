"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. One pass over the texts: the set of distinct five-word shingles, a fingerprint of that set, a signature of
   ``HASHES`` minima and its ``BANDS`` band keys. Documents with equal sets are one class from here on. A class's number
   is a hash of its fingerprint, so texts that share an id are told apart; components are labelled with the least id.
2. Classes that share a band key are candidates. In a small bucket these are all pairs. In a large one every
   member is compared with a few pivots (a linear number of pairs) and links are joined into components. Only
   buckets that then still hold several components go on: members outside their largest component are compared
   with all other members, in blocks of at most ``BLOCK`` by ``BLOCK`` signatures inside one task each. Shingle sets are
   fetched only for what survives step 3 there. So no bucket is capped, gathered in one task or listed pair by pair.
3. Sequential Bayesian verification: signatures are compared batch by batch; a pair is dropped as soon as the
   posterior probability (uniform prior, so an incomplete beta function) that its similarity reaches the threshold
   is under ``MISS``. What survives is verified exactly on the full shingle sets.

At the threshold itself a pair shares no band with probability (1 - 0.75**4)**32 = 5e-6; such a pair is missed.

Defined results: null and blank texts have no shingles, link with nothing and are kept; texts of one to four words
have one shingle; rows that repeat an id and a text give equal rows, texts that share an id are documents of their
own with that id; rows without an id are kept and link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import keyed_text, lean, materialize, prepare
from stratakv.llm.components import components, small_enough
from stratakv.llm.shingles import mix, shingle_sets, signature

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
BATCH, MISS = 16, 1e-6
#: Similarity at which documents are linked, in hundredths.
PERCENT = 75
#: Members of a bucket whose pairs are all listed, and members of a block of a larger one.
SMALL, BLOCK = 24, 512


@cache
def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> tuple[int, ...]:
    """Fewest matches after each batch with which a pair may still reach ``threshold``.

    With m of n minima equal and a uniform prior, the similarity is Beta(m + 1, n - m + 1); its upper tail at t is
    the binomial sum of C(n + 1, k) t**k (1 - t)**(n + 1 - k) over k <= m. Minima are compared by their low
    byte, so unequal ones agree once in 256 times.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


#: What tells rows apart: id and a 128-bit hash of the text.
ROW = ("doc_id", "t1", "t2")


def row_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return keyed_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))


def sketches(texts: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, n_shingles, f1, f2, sig binary, bands array<long>``: a row for each row of ``row_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            size, f1, f2, sig, bands = [], [], [], [], []

            def flush(done: int, upto: int, batch: pa.RecordBatch):
                keys = np.stack(bands) if bands else np.zeros((0, BANDS), np.uint64)
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(done, upto - done) for c in (0, 2, 3)), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))],
                    [*ROW, "n_shingles", "f1", "f2", "sig", "bands"],
                )
                for x in (size, f1, f2, sig, bands):
                    x.clear()
                return out

            k = 0
            for k, grams in enumerate(shingle_sets(batch.column(1)), 1):
                s = signature(grams, HASHES)
                size.append(len(grams))
                f1.append(int(grams.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(grams ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                sig.append((s & np.uint32(255)).astype(np.uint8).tobytes())
                w = s.astype(np.uint64).reshape(BANDS, ROWS)
                bands.append(mix(mix(mix(w[:, 0] << np.uint64(32) | w[:, 1]) ^ (w[:, 2] << np.uint64(32) | w[:, 3])) + np.arange(BANDS, dtype=np.uint64)))
                if len(size) == 4096:
                    yield flush(done, k, batch)
                    done = k
            yield flush(done, k, batch)

    return texts.select("doc_id", "text", "t1", "t2").mapInArrow(lean(run), "doc_id long, t1 long, t2 long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>")


def numbered(sketched: DataFrame) -> DataFrame:
    """``id, n_shingles, f1, f2, doc_id, t1, t2``: a row for each class; its least id and a text of it stand for it."""
    key = ("n_shingles", "f1", "f2")
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct(*ROW)).alias("r"))
    for seed in range(8):
        out = materialize(classes.select(F.xxhash64(*key, F.lit(seed)).alias("id"), *key, "r.*"))
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("class numbers collide")


def promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs that sequential comparison of their signatures does not rule out."""
    need = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(k)) for k in (2, 3))
            yield batch.take(pa.array(_sequential(x, y, np.arange(len(x)), np.arange(len(y)), need))).select(["a", "b"])

    sigs = classes.select("id", "sig")
    two = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _sequential(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs ``(x[i], y[j])`` are left after all batches."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(need):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (x[i[alive], part] == y[j[alive], part]).sum(1)
        go = matches >= least
        alive, matches = alive[go], matches[go]
    return alive


def links_in_blocks(torn: DataFrame, classes: DataFrame, texts: "Texts", percent: int) -> DataFrame:
    """Links ``(a, b)`` between components ``(ca, cb)`` in buckets ``(band, key, id, component)``, outsiders against all.

    Outsiders are the members that are not in the bucket's largest component. Both sides are dealt into blocks, and
    each pair of blocks is a group of its own, of a bounded size: there signatures go through the sequential test, and
    what is left is verified on the full sets, which only these members bring. A pair is looked at in the first band only
    that both agree on. Of an outsider's links into one component, one comes out of a group: the others would join nothing.
    """
    need = least_matches(percent / 100)
    counts = torn.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    buckets = materialize(buckets.select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("out_blocks")))
    rows = torn.join(buckets, "key")
    outer, every = F.pmod(F.xxhash64("id", F.lit(1)), F.col("out_blocks")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("all_blocks"))
    out = rows.where("component <> main").select("band", "key", "id", "component", F.lit(True).alias("outside"), outer.cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("m"))
    inn = rows.select("band", "key", "id", "component", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("o"), every.cast("int").alias("m"))
    sides = out.unionByName(inn).join(classes.select("id", "sig", "bands"), "id")

    def survivors(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """An outsider, and the members of other components that its signature doesn't rule out, by their places."""
        comp, outside = (group.column(c).to_numpy() for c in ("component", "outside"))
        band, sig = group.column("band")[0].as_py(), _matrix(group.column("sig"))
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(comp), BANDS)
        inside = np.flatnonzero(~outside)
        for k in np.flatnonzero(outside).tolist():
            other = inside[(comp[inside] != comp[k]) & ((bands[inside] == bands[k]).argmax(1) == band)]
            other = other[_sequential(sig, sig, np.full(len(other), k), other, need)]
            if len(other):
                yield k, other

    def left_over(group: pa.Table) -> pa.Table:
        """The members that are in any pair that survives, once each: pairs are not listed."""
        stay = np.zeros(group.num_rows, bool)
        for k, other in survivors(group):
            stay[k] = stay[other] = True
        return group.select(member).filter(pa.array(stay))

    def verify(group: pa.Table) -> pa.Table:
        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        size = np.array([len(g) for g in grams])
        a, b = [], []  # places in the group
        for k, other in survivors(group):
            flat = np.concatenate([grams[i] for i in other])
            at = np.minimum(np.searchsorted(grams[k], flat), size[k] - 1)
            both = np.add.reduceat((grams[k][at] == flat).astype(np.int64), np.cumsum(size[other]) - size[other])
            linked = other[100 * both >= percent * (size[k] + size[other] - both)]
            _, one = np.unique(comp[linked], return_index=True)
            a += [k] * len(one)
            b += linked[one].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": ids[a], "b": ids[b], "ca": comp[a], "cb": comp[b]})

    member = ["band", "key", "id", "component", "outside", "o", "m"]
    left = materialize(sides.groupBy("key", "o", "m").applyInArrow(left_over, "band int, key long, id long, component long, outside boolean, o int, m int"))
    sets = materialize(_with_sets(texts.of(left.select("id").distinct())).join(classes, "id").select("id", "grams", "sig", "bands"))
    return left.join(sets, "id").groupBy("key", "o", "m").applyInArrow(verify, "a long, b long, ca long, cb long")


def _with_sets(texts: DataFrame) -> DataFrame:
    """``id, grams binary``: the sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.tobytes() for g in shingle_sets(batch.column(1))], pa.binary())], ["id", "grams"])

    return texts.select("id", "text").mapInArrow(lean(run), "id long, grams binary")


class Texts:
    """The texts of classes, one for each, from all rows and the classes' representatives (materialised)."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes.select("id", *ROW)

    def of(self, ids: DataFrame) -> DataFrame:
        """``id, text``, materialised. Rows that repeat an id and a text are reduced to one."""
        keys = materialize(self.classes.join(small_enough(materialize(ids)), "id"))
        found = materialize(self.rows.join(small_enough(keys), list(ROW)).select("id", "text"))
        return found if found.count() == keys.count() else materialize(found.dropDuplicates(["id"]))


def verified(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs of classes whose full shingle sets are similar enough. ``pairs`` is materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = texts.of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    two = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def near_duplicate_links(classes: DataFrame, texts: Texts, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(links (a, b), components)`` between classes; ``classes``: ``id, sig, bands``, one row for each, materialised."""
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    # counts are written first: a join of two exchanges can split the partition of a key that very many members share
    shared = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    multi = materialize(members.join(shared, "key"))
    small, large = multi.where(F.col("n") <= SMALL), multi.where(F.col("n") > SMALL)
    left, right = (small.select("key", F.col("id").alias(x)) for x in "ab")
    # pivots: the least member, the one that shares most with others (likely the origin of its copies), any one
    weight = large.groupBy("id").agg(F.sum("n").alias("weight"))  # at most a row for each band
    pivots = large.join(weight, "id").groupBy("key").agg(F.min("id").alias("p1"), F.max_by("id", "weight").alias("p2"), F.min_by("id", F.xxhash64("id")).alias("p3"))
    pivots = materialize(pivots)
    stars = large.join(pivots, "key").select("id", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("p")).where("id <> p")
    pairs = left.join(right, "key").where("a < b").select("a", "b").unionByName(stars.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")))
    tried = materialize(promising(pairs.distinct(), classes, percent / 100))
    links = materialize(verified(tried, texts, percent))
    comp = components(links)
    labelled = large.select("band", "key", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    keys = materialize(labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
    torn = materialize(labelled.join(keys, "key", "left_semi"))
    if torn.isEmpty():
        return links, comp
    more = materialize(links_in_blocks(torn, classes, texts, percent))
    return links.unionByName(more.select("a", "b")), joined_up(comp, components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


def joined_up(comp: DataFrame, merged: DataFrame) -> DataFrame:
    """``comp (node, component)`` after ``merged``, the same for components; one with a single node need not be in ``comp``."""
    alone = merged.join(comp, "node", "left_anti")
    again = small_enough(merged.select(F.col("node").alias("component"), F.col("component").alias("root")))
    return materialize(comp.join(again, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(alone))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    prepare(docs.sparkSession)
    texts = row_texts(docs, id_col, text_col)
    every = materialize(sketches(texts))
    key = ["n_shingles", "f1", "f2"]
    reps = numbered(every)
    classes = materialize(every.join(reps, [*key, *ROW]).dropDuplicates(["id"]).select("id", "sig", "bands"))
    _, comp = near_duplicate_links(classes, Texts(texts, reps), percent)
    rooted = materialize(reps.select(*key, "id", F.col("doc_id").alias("least")).join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id")))
    labels = materialize(rooted.groupBy("root").agg(F.min("least").alias("label")))
    out = every.select("doc_id", *key).join(rooted.join(labels, "root").select(*key, "label"), key, "left")
    label = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), (F.col("doc_id").eqNullSafe(label)).alias("kept"))


#: The same rows by counting common shingles of all pairs that have one, and walking the links.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM d),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * n >= 75 * (na + nb - n)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM s LEFT JOIN c ON s.doc_id = c.a
"""
