"""The queries of the corpus operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import bpe, embeddings, licenses, lines, media, minhash, mixing, quality, suffixes, token_counts
from stratakv.llm.common import prepare, spread_table, table

#: Folder of the published vocabulary files; a parameter of the deployment, never copied into the repository.
TOKENIZERS = os.environ.get("STRATAKV_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_scores(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(prepare(spark), sf_dir, "documents"))
    return done.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(prepare(spark), sf_dir, "documents")
    return bpe.bpe_encode(docs, vocabulary("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread_table(prepare(spark), sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spread_table(prepare(spark), sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(prepare(spark), sf_dir, "documents")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(spread_table(prepare(spark), sf_dir, "documents"), with_bytes=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(prepare(spark), sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(prepare(spark), sf_dir, "documents")
    return media.stored_features(media.store_texts(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_lines": op2_lines,
    "op3_bpe": op3_bpe,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_minhash": op6_minhash,
    "op7_token_counts": op7_token_counts,
    "op8_suffixes": op8_suffixes,
    "op9_embeddings": op9_embeddings,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lines": lines.ORACLE,
    "op4_licenses": licenses.oracle(),
    "op5_mixing": mixing.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op8_suffixes": suffixes.ORACLE,
    "op9_embeddings": embeddings.ORACLE,
}
