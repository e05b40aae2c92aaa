"""From raw documents to a mixed, encoded training corpus, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that the one before it kept. All but the
last return the columns of ``documents``. ``run`` writes each result to the shared scratch folder and reads it
again, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import bpe, lines, minhash, mixing, quality
from stratakv.llm.common import keyed_text, materialize, prepare, spread_table, table
from stratakv.llm.components import small_enough
from stratakv.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(~(F.crc32(F.col("doc_id").cast("string")) % 3 == 1))
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(keyed_text(docs), labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays. A null text stays null."""
    done = lines.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    return done.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def rows_numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``: doc_id, or for all texts but one of an id with several, a number that no other row has.

    Rows that repeat an id and a text are one; a null id has a null number.
    """
    counts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = small_enough(materialize(counts.where("n > 1").select("doc_id")))
    if repeated.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    several = materialize(docs.join(repeated, "doc_id", "left_semi").withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]))
    first = materialize(several.groupBy("doc_id").agg(F.min("_sha").alias("_first")))
    ids = docs.select(F.col("doc_id").alias("_row")).where("_row is not null").distinct()
    for seed in range(8):
        other = F.shiftrightunsigned(F.xxhash64("doc_id", "_sha", F.lit(seed)), 1)
        again = materialize(several.join(first, "doc_id").withColumn("_row", F.when(F.col("_sha") == F.col("_first"), F.col("doc_id")).otherwise(other)))
        new = again.where("_sha <> _first").select("_row")
        if new.groupBy("_row").count().where("count > 1").isEmpty() and new.join(ids, "_row", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("row numbers collide")
    once = docs.join(repeated, "doc_id", "left_anti").withColumn("_row", F.col("doc_id"))
    return once.unionByName(again.select(*once.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; of rows that repeat an id and a text, one."""
    rows = rows_numbered(docs.select(*COLUMNS))
    marks = minhash.near_duplicates(rows, id_col="_row")
    gone = materialize(marks.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_row")))
    return rows.join(small_enough(gone), "_row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_copies(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: the training rows as token ids."""
    return bpe.bpe_encode(docs, vocabulary("word_bpe_49k.json"), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can't express the classifier or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
