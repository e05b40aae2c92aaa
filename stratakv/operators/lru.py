"""Exact LRU caches, by simulation along the access log, with byte and entry limits.

A cache is sequential by nature; each shard has its own. The log is cut by shard and time into chunks of about ``CHUNK``
accesses, and a task plays one chunk from the state before it (see ``_Chunks``): it sorts its chunk and holds the cache
(bounded by its limits) and one batch, never a shard's whole log. ``seq`` is taken to tell a shard's accesses apart:
those with the same one are in one chunk. A cache of many more entries than a chunk has accesses costs its size for each
chunk; a limit of entries makes the chunks larger instead.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratakv.operators.replica import sequenced
from stratakv.session import materialize

#: Accesses in a chunk, at least.
CHUNK = 200_000
#: Rounds in which all chunks are played again whose start has changed.
ROUNDS = 4
FEED = ["chunk", "pos", "shard", "seq", "op", "key", "size"]
OUT = "shard int, seq long, op string, key string, hit boolean, evicted array<string>, entries long, bytes long, hits long, misses long"
#: A row with ``at`` -1 about the shard that a chunk ends with (``whole``: it has no other), then a row for each entry held.
END = "chunk int, at long, shard int, key string, size long, digest string, hits long, misses long, whole boolean, full boolean"


@dataclass
class Cache:
    """Least recently used first. Sizes are those of the values."""

    max_bytes: int
    max_entries: int | None = None
    held: OrderedDict[str, int] = field(default_factory=OrderedDict)
    counts: dict[str, int] = field(default_factory=dict)
    size: int = 0
    hits: int = 0
    misses: int = 0

    def get(self, key: str) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            self.counts[key] += 1
            self.hits += 1
            return True
        self.misses += 1
        return False

    def put(self, key: str, size: int) -> list[str]:
        """Evicted keys in order; the old entry of the key itself isn't one. A value over the limit is kept alone."""
        self.delete(key)
        evicted = []
        while self.held and (self.size + size > self.max_bytes or (self.max_entries is not None and len(self.held) >= self.max_entries)):
            evicted.append(next(iter(self.held)))
            self.delete(evicted[-1])
        self.held[key] = size
        self.counts[key] = 1
        self.size += size
        return evicted

    def delete(self, key: str) -> bool:
        size = self.held.pop(key, None)
        self.counts.pop(key, None)
        self.size -= size or 0
        return size is not None

    def contains(self, key: str) -> bool:
        return key in self.held

    def clear(self) -> None:
        self.held.clear()
        self.counts.clear()
        self.size = 0

    def step(self, op: str, key: str, size: int, read_through: bool) -> tuple[bool | None, list[str]]:
        if op == "get":
            hit = self.get(key)
            # a read that a lower tier answers brings the entry in; a negative size says that no tier has it
            return hit, self.put(key, size) if read_through and not hit and size >= 0 else []
        if op == "put":
            return None, self.put(key, size)
        if op == "delete":
            return self.delete(key), []
        if op == "contains":
            return self.contains(key), []
        if op == "clear":
            self.clear()
        return None, []


def simulate(log: DataFrame, max_bytes: int, max_entries: int | None = None, read_through: bool = False) -> DataFrame:
    """One row for each access of ``log (shard, seq, op, key, size)``: hit, evicted keys and the cache's counters."""
    return _simulate(log, max_bytes, max_entries, read_through, [f.split()[0] for f in OUT.split(", ")], False)


def _simulate(log: DataFrame, max_bytes: int, max_entries: int | None, read_through: bool, columns: list[str], recent: bool) -> DataFrame:
    """``recent``: every access brings its key in, so a full cache is the last keys accessed, whatever was held before."""
    limits = (max_bytes, max_entries, read_through)
    log = log.select(F.col("shard").cast("int").alias("shard"), "seq", "op", "key", F.col("size").cast("long").alias("size"))
    most = max(CHUNK, 4 * (max_entries or 0))
    if (rows := log.count()) <= most:
        ordered = log.select(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("pos"), *log.columns).repartition("shard").sortWithinPartitions("shard", "seq")
        return _play(ordered, limits, {}, columns)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    # written once: sampled bounds and accesses with the same seq are then alike in every round
    dealt = materialize(log.repartitionByRange(-(-rows // most), "shard", "seq").sortWithinPartitions("shard", "seq").select(F.spark_partition_id().alias("chunk"), place.alias("pos"), *log.columns))
    return _Chunks(dealt, limits, most // 16, recent).play(columns)


class _Chunks:
    """The chunks of a log and the states between them.

    A chunk starts from the state after the one before it. That is first guessed from the last accesses of the chunk
    before; then every chunk is played, and those are played again whose start turned out different, until none is. The
    states are then those of a run from the first access to the last: the first chunk's start is known, and each end
    follows from its start. Where a change runs on and on (a cache that hardly turns over), chunks are played one by one
    in order after ``ROUNDS`` rounds, so each of them is played at most ``ROUNDS`` + 1 times. If ``recent``, a guess that
    fills the cache is no guess, and its chunk isn't played for its end (so the counters then aren't those of all accesses).
    """

    def __init__(self, dealt: DataFrame, limits: tuple[int, int | None, bool], tail: int, recent: bool) -> None:
        self.dealt, self.limits, self.recent = dealt, limits, recent
        self.spark = dealt.sparkSession
        self.sizes = {r.chunk: r.last + 1 for r in dealt.groupBy("chunk").agg(F.max("pos").alias("last")).collect()}
        self.order = sorted(self.sizes)
        self.before = dict(zip(self.order[1:], self.order, strict=False))
        #: by chunk the last row about its end, and by round what the cache held
        self.ends: dict[int, Row] = {}
        self.held: list[DataFrame] = []
        last = self.spark.createDataFrame([(c, n - tail) for c, n in self.sizes.items()], "chunk int, since long")
        self._note(_play(self._by_chunk(dealt.join(F.broadcast(last), "chunk").where("pos >= since").select(*FEED), self.order), limits, {}, None))
        self.rounds = self._settle()

    def _by_chunk(self, rows: DataFrame, chunks: list[int]) -> DataFrame:
        return rows.repartitionById(len(chunks), "chunk").sortWithinPartitions("chunk", "pos")

    def _note(self, ends: DataFrame) -> None:
        ends = materialize(ends.withColumn("round", F.lit(len(self.held))))
        self.ends |= {r.chunk: r for r in ends.where("at < 0").collect()}
        self.held.append(ends.where("at >= 0"))

    def _settle(self) -> int:
        began: dict[int, str | None] = {}
        starts = lambda: {c: self.ends[self.before[c]].digest if c in self.before else "" for c in self.order}
        rounds = 0
        while changed := [c for c, digest in starts().items() if began.get(c) != digest and not (self.recent and self.ends[c].full)]:
            rounds += 1
            chunks = changed if rounds <= ROUNDS else changed[:1]
            now = starts()
            began |= {c: now[c] for c in chunks}
            self._note(_play(self._rows(chunks), self.limits, {c: (self.ends[self.before[c]].shard, 0, 0) for c in chunks if c in self.before}, None))
        return rounds

    def _rows(self, chunks: list[int]) -> DataFrame:
        """The accesses of ``chunks``, each after the entries that its cache holds at the start."""
        led = [(self.ends[b].round, b, c) for c in chunks if (b := self.before.get(c)) is not None]
        held = reduce(DataFrame.union, self.held).join(F.broadcast(self.spark.createDataFrame(led, "round int, chunk int, next int")), ["round", "chunk"])
        starts = held.select(F.col("next").alias("chunk"), (F.col("at") - (1 << 40)).alias("pos"), "shard", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), "key", "size")
        rows = self.dealt if len(chunks) == len(self.order) else self.dealt.where(F.col("chunk").isin(chunks))
        return self._by_chunk(rows.select(*FEED).union(starts.select(*FEED)), chunks)

    def play(self, columns: list[str]) -> DataFrame:
        starts: dict[int, tuple[int | None, int, int]] = {}
        for c, b in self.before.items():
            end = self.ends[b]
            _, hits, misses = starts.get(b, (None, 0, 0)) if end.whole else (None, 0, 0)
            starts[c] = (end.shard, hits + end.hits, misses + end.misses)
        return _play(self._rows(self.order), self.limits, starts, columns)


def _play(rows: DataFrame, limits: tuple[int, int | None, bool], starts: dict[int, tuple[int | None, int, int]], columns: list[str] | None) -> DataFrame:
    """``columns`` of ``OUT`` for each access of ordered rows, or (None) the state after each chunk as ``END``.

    ``starts`` has the shard, hits and misses that a chunk goes on from; rows with a negative ``pos`` are entries held then.
    """
    max_bytes, max_entries, read_through = limits
    fields = [f for f in OUT.split(", ") if columns and f.split()[0] in columns]
    picked = [i for i, f in enumerate(OUT.split(", ")) if f in fields]
    schema = ", ".join(fields) if columns else END
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, shard, whole, cache = None, None, True, Cache(max_bytes, max_entries)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)

        def end() -> pa.RecordBatch:
            digest = hashlib.blake2b(repr(shard).encode(), digest_size=16)
            for entry in cache.held.items():
                digest.update(repr(entry).encode())
            head = (chunk, -1, shard, None, None, digest.hexdigest(), cache.hits, cache.misses, whole, max_entries is not None and len(cache.held) >= max_entries)
            return made([head, *((chunk, i, shard, key, size, None, None, None, None, None) for i, (key, size) in enumerate(cache.held.items()))])

        for batch in batches:
            out = []
            for c, pos, s, seq, op, key, size in zip(*(batch.column(x).to_pylist() for x in FEED), strict=True):
                if c != chunk:
                    if chunk is not None and columns is None:
                        yield end()
                    chunk, whole = c, True
                    shard, hits, misses = starts.get(c, (s, 0, 0))
                    cache = Cache(max_bytes, max_entries, hits=hits, misses=misses)
                if s != shard:
                    shard, whole, cache = s, False, Cache(max_bytes, max_entries)
                if pos < 0:
                    cache.held[key], cache.counts[key] = size, 1
                    cache.size += size
                    continue
                hit, evicted = cache.step(op, key, -1 if size is None else size, read_through)
                if columns:
                    row = (s, seq, op, key, hit, evicted, len(cache.held), cache.size, cache.hits, cache.misses)
                    out.append([row[i] for i in picked])
            if out:
                yield made(out)
        if chunk is not None and columns is None:
            yield end()

    return rows.mapInArrow(run, schema)


def touches(log: DataFrame, max_entries: int) -> DataFrame:
    """``seq, key, hit`` of a cache in which every access brings its key in and only entries are limited."""
    accesses = log.select(F.lit(0).alias("shard") if "shard" not in log.columns else "shard", "seq", F.lit("get").alias("op"), "key", F.lit(0).alias("size"))
    return _simulate(accesses, 1 << 62, max_entries, True, ["seq", "key", "hit"], True)


def hit_rate(hits: DataFrame) -> DataFrame:
    """``hits, misses, hit_rate`` (0 without accesses) from rows with ``hit``."""
    sums = hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return sums.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.col("hits") / total))


def recency(log: DataFrame) -> DataFrame:
    """``key, last_seq, recency``: keys by last access, 1 the most recent."""
    last = log.groupBy("key").agg(F.max("seq").alias("last_seq")).withColumn("_back", -F.col("last_seq"))
    return sequenced(last, "_back").select("key", "last_seq", F.col("seq").alias("recency"))
