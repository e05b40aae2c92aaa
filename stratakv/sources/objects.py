"""The object tier: a backend interface, one in memory, one over parquet, and a wrapper with a key prefix."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.session import scratch_dir
from stratakv.sources.versions import PackedTable

OBJECT = T.StructType([T.StructField("object_key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("original_key", T.StringType()), T.StructField("content_type", T.StringType())])
OCTETS = "application/octet-stream"


class Backend(ABC):
    """Sets of objects in and out; a key that is missing is no error."""

    @abstractmethod
    def objects(self) -> DataFrame: ...

    @abstractmethod
    def put(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def delete(self, keys: DataFrame) -> None: ...

    def get(self, keys: DataFrame) -> DataFrame:
        return self.objects().join(keys.select("object_key").distinct(), "object_key", "left_semi")

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.select("object_key").distinct().join(self.objects().select("object_key"), "object_key", "left_semi")

    def head(self, keys: DataFrame) -> DataFrame:
        """Metadata without values: the value column isn't read."""
        return self.get(keys).drop("value")

    def list(self, prefix: str) -> DataFrame:
        return self.objects().select("object_key").where(F.col("object_key").startswith(prefix))


class ParquetBackend(Backend):
    """Objects as a versioned table on any Hadoop file system (local, abfss, s3a, ...), values compressed."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = PackedTable(spark, path, OBJECT, "object_key")

    def objects(self) -> DataFrame:
        return self.table.read().drop("size")

    def put(self, rows: DataFrame) -> None:
        self.table.apply(upserts=rows)

    def delete(self, keys: DataFrame) -> None:
        self.table.apply(deletes=keys)


class MemoryBackend(ParquetBackend):
    """Objects of this session: a table in the scratch folder, so a change costs its own size and rows don't hang on their sources."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, scratch_dir(spark))

    def clear(self) -> None:
        self.__init__(self.table.spark)

    def count(self) -> int:
        return self.objects().count()


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """Objects stored as one file each: what a blob store can tell of them (time of change, full name)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("object_key"), F.col("content").alias("value"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"), F.col("path").alias("original_key"), F.lit(OCTETS).alias("content_type"))


class ObjectTier:
    """A backend seen through a bucket name and a key prefix."""

    def __init__(self, backend: Backend, bucket: str = "stratakv-data", prefix: str = "data/"):
        self.backend, self.bucket, self.prefix = backend, bucket, prefix

    def _full(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.concat(F.lit(self.prefix), F.col("key")).alias("object_key"))

    def _bare(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", F.expr(f"substring(object_key, {len(self.prefix) + 1})")).drop("object_key")

    def put(self, rows: DataFrame, created_at: str, content_type: str = OCTETS) -> None:
        """``rows``: ``key, value`` and perhaps ``content_type``, ``original_key``, ``created_at``; what a row doesn't give is filled in."""
        given = lambda name, default: F.coalesce(F.col(name), default) if name in rows.columns else default
        self.backend.put(rows.select(F.concat(F.lit(self.prefix), F.col("key")).alias("object_key"), "value", F.octet_length("value").cast("long").alias("size_bytes"), given("created_at", F.lit(created_at).cast("timestamp_ntz")).alias("created_at"), given("original_key", F.col("key")).alias("original_key"), given("content_type", F.lit(content_type)).alias("content_type")))

    def get(self, keys: DataFrame) -> DataFrame:
        return self._bare(self.backend.get(self._full(keys)))

    def head(self, keys: DataFrame) -> DataFrame:
        return self._bare(self.backend.head(self._full(keys)))

    def exists(self, keys: DataFrame) -> DataFrame:
        return self._bare(self.backend.exists(self._full(keys)))

    def list(self, prefix: str = "") -> DataFrame:
        """Keys below a prefix, without the tier's own prefix."""
        return self._bare(self.backend.list(self.prefix + prefix))

    def delete_batch(self, keys: DataFrame) -> int:
        """How many of the keys were there; repeated keys count once."""
        full = self._full(keys).distinct()
        n = self.backend.exists(full).count()
        self.backend.delete(full)
        return n


def open_backend(spark: SparkSession, account: str | None = None, access_key: str | None = None, container: str | None = None, path: str | None = None) -> Backend:
    """A blob store if both credentials are given, a folder if one is, else memory (which ends with the session)."""
    if account and access_key and container:
        spark.conf.set(f"fs.azure.account.key.{account}.dfs.core.windows.net", access_key)
        return ParquetBackend(spark, f"abfss://{container}@{account}.dfs.core.windows.net/objects")
    return ParquetBackend(spark, path) if path else MemoryBackend(spark)
