"""Tables that change by segments: a base and the batches since, folded when read, compacted now and then.

Plain parquet can't be changed in place, and rewriting a large table for each batch would move all of it. A batch is
written as a segment of its own (new rows, and tombstones for deleted keys); a small manifest names the segments in
order, with their row counts. Manifests are numbered: the next one is written under another name and renamed as the
last step, and only then older ones go, so a job that fails at any point leaves the table as it was. Segments
without any manifest are an error, not an empty table. Reading takes the last word on each key. Readers keep the segments that they opened; those of the last ``KEEP`` compactions stay.
Paths go through Hadoop's file system, so a table can be on any of its schemes. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from stratakv.functions import codec

#: Batches until the table is compacted; most rows of all batches that are broadcast when read (keys, and numbers).
BATCHES, BROADCAST_ROWS = 8, 1_000_000
KEEP = 2


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "key"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.stored = StructType([*schema.fields, StructField("_n", IntegerType()), StructField("_gone", BooleanType())])

    # -- the manifest --------------------------------------------------------------------------------------

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        """Numbers of the manifests, in order."""
        fs, pattern = self._fs("MANIFEST-*")
        names = [f.getPath().getName().partition("-")[2] for f in fs.globStatus(pattern) or []]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> dict:
        """``{"version", "next", "segments": [[number, rows], ...], "old": [[numbers of a compaction], ...], "tags"}``; the first segment is the base."""
        versions = self._versions()
        if not versions:
            fs, segments = self._fs("s[0-9]*")
            if fs.globStatus(segments):
                raise OSError(f"{self.path}: there are segments, but no manifest")
            return {"version": -1, "next": 0, "segments": [], "old": [], "tags": {}}
        fs, p = self._fs(f"MANIFEST-{versions[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _replace(self, before: dict, **changes) -> None:
        """The manifest after ``before``. A second writer finds the name taken and fails."""
        version = before["version"] + 1
        fs, new = self._fs(f"_manifest-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.writeUTF(json.dumps(before | changes | {"version": version}))
        stream.close()
        _, name = self._fs(f"MANIFEST-{version}")
        if fs.exists(name) or not fs.rename(new, name):
            fs.delete(new, False)
            raise OSError(f"{self.path}: manifest {version} is there already")
        for k in self._versions()[:-KEEP]:
            fs.delete(self._fs(f"MANIFEST-{k}")[1], False)

    def tags(self) -> dict:
        """What the last batches noted, such as the epochs of streams."""
        return self.manifest()["tags"]

    def _scan(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/s{n}" for n in numbers])

    # -- reading -------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The rows as they are now."""
        return self._fold()

    def _fold(self) -> DataFrame:
        """The rows as they are stored. The base is only filtered (not shuffled while the batches' keys are few)."""
        segments = self.manifest()["segments"]
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        columns = [f.name for f in self.schema]
        base = self._scan([segments[0][0]]).select(*columns)
        if len(segments) == 1:
            return base
        since = self._scan([n for n, _ in segments[1:]])
        last = since.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in columns if c != self.key], "_gone"), "_n").alias("l"))
        touched = since.select(self.key).distinct()
        if sum(rows for _, rows in segments[1:]) <= BROADCAST_ROWS:
            touched = F.broadcast(touched)
        changed = last.where("not l._gone").select(self.key, *[F.col(f"l.{c}").alias(c) for c in columns if c != self.key])
        return base.join(touched, self.key, "left_anti").unionByName(changed).select(*columns)

    # -- writing -------------------------------------------------------------------------------------------

    def _stored_form(self, rows: DataFrame) -> DataFrame:
        return rows

    def _write(self, number: int, rows: DataFrame) -> int:
        """Clustered by key, so that row-group statistics serve point reads; how many rows it has."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/s{number}")
        return self._scan([number]).count()

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, tags: dict | None = None) -> None:
        """One batch: rows to put and keys to delete; a key in both is put. A key that is null or put twice is refused.

        ``tags`` are noted in the manifest in the same step.
        """
        m = self.manifest()
        if m["version"] < 0:
            self._replace(m)
            m = self.manifest()
        parts = []
        if upserts is not None:
            parts.append(self._stored_form(upserts).select(*[f.name for f in self.schema]).withColumn("_gone", F.lit(False)))
        if deletes is not None:
            keys = deletes.select(self.key).distinct()
            keys = keys if upserts is None else keys.join(upserts.select(self.key), self.key, "left_anti")
            empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema]
            parts.append(keys.select(*empty, F.lit(True).alias("_gone")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        n = m["next"]
        count = self._write(n, rows.withColumn("_n", F.lit(n)))
        if upserts is not None and self._scan([n]).agg(F.count_distinct(self.key)).first()[0] != count:
            fs, segment = self._fs(f"s{n}")
            fs.delete(segment, True)
            raise ValueError("a batch holds a key twice, or one that is null")
        old = m["old"]
        if not m["segments"]:  # nothing to delete from yet: a base
            count = self._write(n + 1, self._scan([n]).where("not _gone"))
            old, n = [*old, [n]], n + 1
        self._replace(m, next=n + 1, segments=[*m["segments"], [n, count]], old=old, tags=m["tags"] | (tags or {}))
        if len(m["segments"]) >= BATCHES:
            self.compact()

    def compact(self) -> None:
        """A new base; segments that an earlier compaction put aside go, the ones of the last stay for their readers."""
        m = self.manifest()
        n = m["next"]
        count = self._write(n, self._fold().withColumn("_n", F.lit(n)).withColumn("_gone", F.lit(False)))
        old = [*m["old"], [k for k, _ in m["segments"]]]
        self._replace(m, next=n + 1, segments=[[n, count]], old=old[-KEEP:])
        for numbers in old[:-KEEP]:
            for k in numbers:
                fs, p = self._fs(f"s{k}")
                fs.delete(p, True)


class PackedTable(VersionedTable):
    """A table whose ``value`` is stored as a zstd frame beside its ``size`` before compression.

    Reading inflates values only where a plan asks for them; sizes and the other columns are read without. Values
    may be any bytes: text comes back as it is, ``cast('binary')`` gives the bytes of others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "key"):
        fields = [StructField("value", BinaryType()) if f.name == "value" else f for f in schema]
        super().__init__(spark, path, StructType([*fields, StructField("size", LongType())]), key)

    def _stored_form(self, rows: DataFrame) -> DataFrame:
        raw = F.col("value").cast("binary")
        return rows.withColumn("size", F.octet_length(raw).cast("long")).withColumn("value", codec.compress(raw))

    def read(self) -> DataFrame:
        return self._fold().withColumn("value", codec.decompress(F.col("value")).cast("string"))
