"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

1. Terms of a text: hashed byte trigrams of the whole text (sublinear counts) and binned shape measures (share of
   capitals, digits, marks, repeated trigrams, length, ...). Document frequencies come from *all* documents.
2. A bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id) is turned into tf-idf vectors;
   the leading eigenvectors of their Gram matrix give the latent space (truncated SVD).
3. The labelled latent vectors (``sample_rows x dims`` floats: about 1 MB at the defaults, whatever the corpus)
   are broadcast. Every document is projected and its cosine with *every* labelled vector computed exactly, in
   blocks of rows; the ``neighbours`` most similar vote, weighted by a power of their similarity.

Defined results: a null text counts as empty and is scored like any other; labels that are null or neither 0 nor 1
are not learnt from; several labels of one id count as their mean; without any usable label every score is 0.5;
an empty table gives an empty result; repeated rows get equal scores (vectors are rounded to whole numbers whose
products add up without error, so no sum depends on the shape of a batch); other columns never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import byte_slices, keyed_text, lean, prepare

BUCKETS = 2048
#: Bins of each shape measure, and how strongly their terms count against the trigrams.
BINS, SHAPE_WEIGHT = 12, 0.6
SHAPES = 10
TERMS = BUCKETS + SHAPES * (BINS + 1)
SAMPLE_ROWS, DIMS, NEIGHBOURS, SHARPNESS = 4096, 48, 11, 8
BLOCK = 512
#: Weights and latent vectors are multiples of these parts of 1. Sums of such products stay under 2**53, so they are exact.
WEIGHT_UNIT, VECTOR_UNIT = 1 << 14, 1 << 20
SLICE = 500_000

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[128:] = 6


def term_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``(texts, TERMS)`` weights before idf: logarithms of trigram counts, and soft bins of the shape measures."""
    n = len(offs) - 1
    size = np.diff(offs)
    row = np.repeat(np.arange(n), size)
    counts = np.zeros((n, BUCKETS), np.float32)
    total = np.maximum(size - 2, 0)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        bucket = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761) >> np.uint32(32 - 11)).astype(np.int64)
        inside = row[:-2] == row[2:]
        counts = np.bincount((row[:-2] * BUCKETS + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    kinds = np.bincount(row * 8 + _KIND[data], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    shape = np.zeros((n, SHAPES), np.float64)
    shape[:, :6] = np.sqrt(kinds[:, 1:7])
    shape[:, 6] = np.log1p(size) / 14
    shape[:, 7] = np.sqrt(counts.max(1, initial=0) / np.maximum(total, 1))
    shape[:, 8] = (counts > 0).sum(1) / np.maximum(BUCKETS * -np.expm1(-total / BUCKETS), 1)
    shape[:, 9] = np.sqrt(np.square(counts / np.maximum(total, 1)[:, None]).sum(1))
    at = np.clip(shape, 0, 1) * (BINS - 1)
    low = np.floor(at).astype(np.int64)
    bins = np.zeros((n, SHAPES, BINS + 1), np.float32)
    i, j = np.arange(n)[:, None], np.arange(SHAPES)[None, :]
    bins[i, j, low] += 1 - (at - low)
    bins[i, j, low + 1] += at - low
    return np.concatenate([np.log1p(counts), bins.reshape(n, -1)], 1)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: int

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return weigh(counts, self.idf)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1, in whole numbers of ``VECTOR_UNIT``."""
        return latent(self.weigh(counts), self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted vote of the nearest labelled vectors, from all cosines, block by block."""
        out = np.full(len(counts), 0.5)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for a in range(0, len(counts), BLOCK):
            cosine = self.latent(counts[a : a + BLOCK]) @ self.vectors.T / VECTOR_UNIT**2
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.broadcast_to(np.arange(k), (len(cosine), k))
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 1e-3) ** self.sharpness
            out[a : a + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf: the trigrams of a text have length 1 together, each shape measure has ``SHAPE_WEIGHT``."""
    x = counts * idf
    x[:, :BUCKETS] /= np.maximum(np.linalg.norm(x[:, :BUCKETS], axis=1, keepdims=True), 1e-12)
    x[:, BUCKETS:] *= SHAPE_WEIGHT
    return x


def latent(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = np.rint(x.astype(np.float64) * WEIGHT_UNIT) @ np.rint(basis.astype(np.float64) * WEIGHT_UNIT)
    return np.rint(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) * VECTOR_UNIT)


def _counts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, last, data, offs in byte_slices(column, SLICE):
        yield first, last, term_counts(data, offs)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each term occurs, and how many texts there are: ``TERMS`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for _, _, counts in _counts_of(batch.column(0)):
                df[:-1] += (counts > 0).sum(0)
                df[-1] += len(counts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in docs.select("text").mapInArrow(lean(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def labelled_sample(labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most ``rows`` pairs ``(doc_id, label)``, chosen by a hash of the id, so that reruns agree."""
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("doc_id is not null and label in (0, 1)")
    return usable.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, dims: int = DIMS, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> Model:
    """``docs``: keyed text. ``labels``: ``doc_id, quality`` of the rows that may be learnt from."""
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    idf[BUCKETS:] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, counts in _counts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array([x.astype(np.float16).tobytes() for x in counts], pa.binary())], ["doc_id", "label", "counts"])

    sample = F.broadcast(labelled_sample(labels, sample_rows))  # two numbers for each of at most sample_rows ids
    each = docs.join(sample, "doc_id").select("doc_id", "text", "label").mapInArrow(lean(run), "doc_id long, label double, counts binary")
    # one text of an id is enough: of several, the least, chosen before anything reaches the driver
    got = each.groupBy("doc_id", "label").agg(F.min("counts").alias("counts")).toPandas().sort_values("doc_id").reset_index(drop=True)
    if not len(got):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), np.zeros(0), neighbours, sharpness)
    x = np.stack([np.frombuffer(c, np.float16) for c in got["counts"]]).astype(np.float32)
    x = weigh(x, idf)
    _, v = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(v[:, ::-1][:, : min(dims, len(x))]).astype(np.float32)
    return Model(idf, basis, latent(x, basis), got["label"].to_numpy(np.float64), neighbours, sharpness)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of keyed text, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, last, counts in _counts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(m.scores(counts), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores at least ``threshold``."""
    shared, at, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, last, counts in _counts_of(batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array(m.scores(counts) >= threshold))

    prepare(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows whose ``crc32(doc_id) mod 3`` is 1 are held out from learning."""
    prepare(docs.sparkSession)
    texts = keyed_text(docs, id_col, text_col)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(texts, labels.where(~(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1)), **options)
    return score(texts, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
