"""Removal of long repeats by blockwise suffix sorting with difference-cover ranks.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else. The suffixes of all documents are
put into buckets, and buckets are sorted block by block:

1. Anchors. Each string of ``WINDOW`` bytes has an anchor: its ``GRAM`` bytes of least hash. Equal strings have equal
   anchors at equal distances, so suffixes whose anchor occurs once are unique and are left out. That is all that
   hashes decide. Neighbouring suffixes mostly share an anchor; one row stands for such a run (about one for 60 bytes).
2. The runs of an anchor that occurs again are its bucket, with all bytes that they read. Blocks of whole buckets are laid
   out by distance from the anchor and sorted. Runs that read equal bytes are one kind; a kind of two runs repeats whole.
3. The kinds of a bucket are told apart string by string: for a difference cover (modulo ``PERIOD``) of the places, ranks
   of 16, 32, 64 and 128 bytes are computed once for the block by doubling. Suffixes that start at one distance are
   sorted by two cover ranks; only ties look at the at most 14 bytes between.
   A block holds ``BLOCK_ROWS`` runs and at most a bucket more, whatever the corpus, so memory is bounded.
4. A bucket with more than ``HOT`` runs is dealt into parts. Each is sorted into kinds, and one run of a kind goes on.
   If still more than ``HOT`` are left, their parts are sorted like other buckets, and only strings that stay single in
   their part are compared with those of other parts: as whole strings (aggregated map-side first), of which the bytes
   before and after the anchor, sorted by range, agree with any other run at all.

Repeats never cross documents. Defined results: null texts count as empty; texts under ``WINDOW`` bytes lose nothing;
rows that repeat a text lose all of it (if it is long enough), also when they repeat the id or have none; rows are told
apart by id and a 128-bit hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import keyed_text, materialize, prepare, text_bytes
from stratakv.llm.shingles import mix, powers

WINDOW, GRAM = 200, 64
#: Distances of a string's begin from its anchor, and columns of a bucket's layout (anchors at column ``REACH``).
REACH = WINDOW - GRAM
COLUMNS = REACH + WINDOW
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
BLOCK_ROWS, HOT = 8192, 1024
#: Bytes of one numpy pass; texts are cut into overlapping passes, since only the string itself decides its anchor.
PASS = 1 << 18
_INDEX = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: What tells rows apart: id and a 128-bit hash of the text.
ROW = ("doc_id", "t1", "t2")


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(h, first start, starts, distance)`` of the runs of one text's strings that share an anchor."""
    parts = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), PASS):
        d = data[at : at + PASS + WINDOW - 1]
        n = len(d)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[d] * up[:n], out=total[1:])
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        least = (gram & ~_INDEX) | np.arange(len(gram), dtype=np.uint64)
        span, width = REACH + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := span - width:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & _INDEX).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        p = place[lo]
        parts.append((gram[p], lo + at, np.diff(np.r_[lo, len(place)]), p - lo))
    if not parts:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(texts: DataFrame) -> DataFrame:
    """``h, doc_id, t1, t2, at`` for rows ``doc_id, text, t1, t2``: a row for each run.

    ``at`` packs its first start, its starts and its distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            keys, o = [batch.column(c) for c in (0, 2, 3)], offs.tolist()
            held, out = 0, []
            for k in range(batch.num_rows):
                h, lo, n, a = anchors(data[o[k] : o[k + 1]])
                if len(h):
                    out.append((h, np.full(len(h), k), lo << 20 | n << 10 | a))
                    held += len(h)
                if out and (held > 200_000 or k == batch.num_rows - 1):
                    yield packed(out, keys)
                    held, out = 0, []

    def packed(out: list, keys: list[pa.Array]) -> pa.RecordBatch:
        h, row, at = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(c.take(pa.array(row)) for c in keys), pa.array(at)], ["h", *ROW, "at"])

    return texts.select("doc_id", "text", "t1", "t2").mapInArrow(run, "h long, doc_id long, t1 long, t2 long, at long")


def regions(texts: DataFrame, again: DataFrame) -> DataFrame:
    """``h, parts, doc_id, t1, t2, at, bytes``: the runs ``h, doc_id, t1, t2, at, parts`` with the bytes that they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            raw, found = data.tobytes(), batch.column(4)
            at, h, parts = (found.flatten().field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            begin = offs[row] + (at >> 20)
            end = begin + (at >> 10 & 1023) + WINDOW - 1
            for k in range(0, len(row), 16_384):
                part = slice(k, k + 16_384)
                cut = [raw[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(parts[part]), *(batch.column(c).take(pa.array(row[part])) for c in (0, 2, 3)), pa.array(at[part]), pa.array(cut, pa.binary())], ["h", "parts", *ROW, "at", "bytes"])

    # a set: rows that repeat an id and a text have the same runs. A document has fewer runs than bytes
    by_doc = again.groupBy(*ROW).agg(F.collect_set(F.struct("at", "h", "parts")).alias("runs"))
    return _with_row(texts, by_doc, "inner").select("doc_id", "text", "t1", "t2", "runs").mapInArrow(run, "h long, parts int, doc_id long, t1 long, t2 long, at long, bytes binary")


def _with_row(texts: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with a side that has one row for each (id, text); ids may be null."""
    side = side.withColumnsRenamed({"doc_id": "_id", "t1": "_1", "t2": "_2"})
    return texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")), how).drop("_id", "_1", "_2")


# -- the sort of a block ---------------------------------------------------------------------------------------


@cache
def cover_columns() -> np.ndarray:
    return np.array([c for c in range(COLUMNS) if c % PERIOD in COVER])


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank of each row (equal rows alike), given an order that sorts the rows by ``keys``."""
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def cover_ranks(rows: np.ndarray, longest: int = 128) -> dict[int, np.ndarray]:
    """For each column of the cover: ranks of the rows by the ``longest`` bytes from there, by doubling."""
    ranks = {}
    for c in cover_columns().tolist():
        if c + 16 <= COLUMNS:
            two = np.ascontiguousarray(rows[:, c : c + 16]).view(">u8").astype(np.uint64)
            ranks[c] = _dense(np.lexsort((two[:, 1], two[:, 0])), two[:, 0], two[:, 1])
    depth = 16
    while depth < longest:
        new = {}
        for c, x in ranks.items():
            if (y := ranks.get(c + depth)) is not None:
                both = x << 32 | y
                new[c] = _dense(np.argsort(both, kind="stable"), both)
        ranks, depth = new, 2 * depth
    return ranks


def _bytes_as_number(rows: np.ndarray, begin: int, end: int) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for c in range(begin, end):
        out = out << 8 | rows[:, c]
    return out


def repeated_starts(rows: np.ndarray, bucket: np.ndarray, distance: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(rows, REACH + 1)`` booleans: whether the string of a row that starts at a column has an equal in its bucket.

    ``rows``: bytes by column; ``bucket``: dense numbers; a row has the strings of columns ``REACH - distance``
    and the ``starts - 1`` after it.
    """
    ranks, n = cover_ranks(rows), len(rows)
    columns = np.array(sorted(ranks))
    out = np.zeros((n, REACH + 1), bool)
    first = REACH - distance
    for s in range(REACH + 1):
        own = np.flatnonzero((first <= s) & (s < first + starts))
        if len(own) < 2:
            continue
        c1 = int(columns[np.searchsorted(columns, s)])
        c2 = int(columns[np.searchsorted(columns, s + WINDOW - 128, side="right") - 1])
        key = (bucket[own] << 20 | ranks[c1][own]) << 20 | ranks[c2][own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        tie = np.zeros(len(k) + 1, bool)
        tie[1:-1] = k[1:] == k[:-1]
        tied = own[order[tie[1:] | tie[:-1]]]
        if not len(tied):
            continue
        # ties of both ranks: the bytes before the first and after the last ranked part
        head, tail = _bytes_as_number(rows[tied], s, c1), _bytes_as_number(rows[tied], c2 + 128, s + WINDOW)
        k = (bucket[tied] << 20 | ranks[c1][tied]) << 20 | ranks[c2][tied]
        order = np.lexsort((tail, head, k))
        same = (np.diff(k[order]) == 0) & (np.diff(head[order]) == 0) & (np.diff(tail[order]) == 0)
        both = np.zeros(len(order) + 1, bool)
        both[1:-1] = same
        out[tied[order[both[1:] | both[:-1]]], s] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first, end)`` of the runs of true cells in each row."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    r, first = np.nonzero(step == 1)
    return r, first, np.nonzero(step == -1)[1]


def shared_length(contexts: DataFrame) -> DataFrame:
    """``h, context, ext``: the most leading bytes that a context has in common with another of its bucket.

    In sorted order that is with a neighbour. Contexts are sorted by range over all tasks, equal ones once (they agree
    in full); at the ends of a partition, where a neighbour is out of sight, the full length is the safe answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def common(a: bytes, b: bytes) -> int:
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            return int(differ[0]) if len(differ) else n

        held, before = None, None  # a row waits for the one after it
        for batch in batches:
            out = []
            for h, c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                link = None if held is None else common(held[1], c) if held[0] == h else 0
                if held is not None:
                    out.append((held[0], held[1], len(held[1]) if held[2] > 1 or before is None else max(before, link)))
                held, before = (h, c, n), link
            yield rows(out)
        if held is not None:
            yield rows([(held[0], held[1], len(held[1]))])

    def rows(x: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.binary()), pa.array([r[2] for r in x], pa.int32())], ["h", "context", "ext"])

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = contexts.groupBy("h", "context").agg(F.count("*").alias("n"))
    return once.repartitionByRange(n, "h", "context").sortWithinPartitions("h", "context").mapInArrow(run, "h long, context binary, ext int")


class Block:
    """Whole buckets of runs ``h, part, at, bytes, ...``, laid out by distance from the anchor and sorted into kinds."""

    def __init__(self, tables: list[pa.RecordBatch]):
        self.table = t = pa.Table.from_batches(tables).combine_chunks()
        self.n = n = t.num_rows
        at = t.column("at").to_numpy()
        self.lo, self.starts, self.distance = at >> 20, at >> 10 & 1023, at & 1023
        self.rows = np.zeros((n, COLUMNS), np.uint8)
        data, offs = text_bytes(t.column("bytes"))
        size = np.diff(offs)
        where = np.repeat(np.arange(n) * COLUMNS + REACH - self.distance - offs[:-1], size)
        where += np.arange(len(data))
        self.rows.ravel()[where] = data
        h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
        self.change = np.r_[False, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
        self.bucket = np.cumsum(self.change)
        shape = np.stack([self.bucket, self.starts << 10 | self.distance], 1).astype(">u4").view(np.uint8).reshape(n, 8)
        key = np.ascontiguousarray(np.concatenate([shape, self.rows], 1))
        #: A run of each kind, the kind of each run, and how many runs each kind has. Kinds come in order of their buckets.
        _, self.one, self.kind, self.count = np.unique(key.view(np.dtype((np.void, key.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def repeats(self, wanted: np.ndarray) -> np.ndarray:
        """``(kinds, REACH + 1)``: whether the string that starts at a column is also one of another kind of its bucket."""
        out = np.zeros((len(self.one), REACH + 1), bool)
        bucket = self.bucket[self.one]
        pick = np.flatnonzero(wanted & (np.bincount(bucket, minlength=self.n)[bucket] > 1))
        if len(pick):
            at = self.one[pick]
            _, dense = np.unique(bucket[pick], return_inverse=True)
            out[pick] = repeated_starts(self.rows[at], dense, self.distance[at], self.starts[at])
        return out

    def spans(self, flags: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> pa.Array:
        """For each run, first and end of its ranges of repeated starts: all of it for ``whole`` ones, else ``flags`` of ``rows``."""
        r, a, b = _ranges(flags)
        begin = (self.lo - (REACH - self.distance))[rows[r]]
        row = np.concatenate([whole, rows[r]])
        first, end = np.concatenate([self.lo[whole], begin + a]), np.concatenate([self.lo[whole] + self.starts[whole], begin + b])
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(2 * np.bincount(row, minlength=self.n))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.stack([first, end], 1)[order].ravel(), pa.int64()))

    def output(self, keep: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        own = {c: self.table.column(c).combine_chunks() for c in ROW}
        out = pa.RecordBatch.from_arrays([*own.values(), *columns.values()], [*own, *columns])
        return out.filter(pa.array(keep))


def sort_buckets(found: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, spans, h, at, c, bytes, before, after`` for runs ``h, part, parts, ...`` that lie by ``h, part``.

    ``spans``: first and end of ranges of starts that repeat. Of a part of a larger bucket, only equal runs are settled,
    and one run of each kind goes on (``bytes`` and what surrounds the anchor, outwards; ``c``: runs of its kind).
    """

    def settle(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        k = Block(tables)
        dealt = k.numbers("parts") > 1
        many = k.count[k.kind] > 1
        flags = k.repeats(~dealt[k.one]) & (k.count == 1)[:, None]
        spans = k.spans(flags, k.one, np.flatnonzero(many))
        on = np.zeros(k.n, bool)
        on[k.one] = dealt[k.one]
        at = np.flatnonzero(on)
        read = k.table.column("bytes").combine_chunks()
        raw, a = read.take(pa.array(at)).to_pylist(), k.distance[at].tolist()
        where = pa.array(np.where(on, np.cumsum(on) - 1, 0), mask=~on)
        side = lambda x: pa.array(x, pa.binary()).take(where)
        sides = [side([x[:d][::-1] for x, d in zip(raw, a, strict=True)]), side([x[d + GRAM :] for x, d in zip(raw, a, strict=True)])]
        keep = on | (np.diff(spans.offsets.to_numpy()) > 0)
        return k.output(keep, {"spans": spans, "h": k.table.column("h").combine_chunks(), "at": k.table.column("at").combine_chunks(), "c": pa.array(k.count[k.kind], pa.int64()), "bytes": side(raw), "before": sides[0], "after": sides[1]})

    return found.mapInArrow(lambda batches: _in_blocks(batches, settle), "doc_id long, t1 long, t2 long, spans array<long>, h long, at long, c long, bytes binary, before binary, after binary")


def sort_parts(found: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, spans, open, strings`` for kinds ``h, part, parts, c, at, bytes, before, after`` by ``h, part``.

    Of buckets in several parts, ``strings`` has those that are the only or first of their kind in the part, ``open``
    their starts (-1: repeats already). ``before, after``: bytes before and after the anchor in which such a run agrees
    with any other.
    """

    def settle(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        k = Block(tables)
        flags = k.repeats(np.ones(len(k.one), bool))
        fresh = k.numbers("c") == 1
        again = k.count[k.kind] > 1
        alone = np.flatnonzero(fresh & ~again)
        spans = k.spans(flags[k.kind[alone]], alone, np.flatnonzero(fresh & again))
        before, after, parts = k.numbers("before"), k.numbers("after"), k.numbers("parts")
        opened: list[list[int]] = [[] for _ in range(k.n)]
        strings: list[list[bytes]] = [[] for _ in range(k.n)]
        for group in np.split(np.arange(k.n), np.flatnonzero(k.change)):
            if parts[group[0]] < 2:
                continue
            seen: set[bytes] = set()
            for i in group.tolist():
                raw, f, begin = k.rows[i].tobytes(), int(REACH - k.distance[i]), int(k.lo[i] - (REACH - k.distance[i]))
                # a string has REACH - s bytes before the anchor and s after it
                for s in range(max(f, REACH - int(before[i])), min(f + int(k.starts[i]), int(after[i]) + 1)):
                    known = bool(flags[k.kind[i], s] or again[i] or not fresh[i])
                    string = bytes([s]) + raw[s : s + WINDOW]
                    if known and string in seen:
                        continue
                    seen.add(string)
                    opened[i].append(-1 if known else begin + s)
                    strings[i].append(string)
        keep = (np.diff(spans.offsets.to_numpy()) > 0) | np.array([bool(x) for x in strings])
        return k.output(keep, {"spans": spans, "open": pa.array(opened, pa.list_(pa.int64())), "strings": pa.array(strings, pa.list_(pa.binary()))})

    return found.mapInArrow(lambda batches: _in_blocks(batches, settle), "doc_id long, t1 long, t2 long, spans array<long>, open array<long>, strings array<binary>")


def _in_blocks(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``h, part``, cut into blocks of whole buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= BLOCK_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
            if not len(cuts):
                break  # one bucket so far: it goes on
            upto = int(cuts[min(np.searchsorted(cuts, BLOCK_ROWS), len(cuts) - 1)])
            yield settle(t.slice(0, upto).to_batches())
            held = t.slice(upto).to_batches()
            if upto < BLOCK_ROWS // 2:
                break
    if held and sum(b.num_rows for b in held):
        yield settle(held)


# -- from documents to documents -------------------------------------------------------------------------------


def covered(spans: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges under strings that start in the ranges ``spans`` (first, end, first, end, ...)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        b = min(b - 1 + WINDOW, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary, kept_sha256 string"


def _result(ids: list, texts: list[bytes], spans: list[list[int]], with_bytes: bool) -> list[pa.Array]:
    gone = [covered(s, len(x)) for s, x in zip(spans, texts, strict=True)]
    kept = [without(x, g) for x, g in zip(texts, gone, strict=True)]
    return [
        pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) - len(k) for x, k in zip(texts, kept, strict=True)], pa.int64()), pa.array([[y for ab in g for y in ab] for g in gone], pa.list_(pa.int64())),
        pa.array(kept if with_bytes else [None] * len(kept), pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, kept_sha256`` for each row of ``docs``.

    ``spans``: first and end of each maximal removed range; ``kept``: the bytes left, if ``with_bytes``.
    """
    prepare(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    every = runs(texts)
    # written first: a join of two exchanges can split the partition of an anchor that very many runs share
    by_h = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    again = materialize(every.join(by_h, "h"))
    dealt = regions(texts, again).withColumn("part", F.pmod(F.xxhash64(*ROW, "at"), F.col("parts")).cast("int"))
    found = materialize(sort_buckets(dealt.repartition(n, "h", "part").sortWithinPartitions("h", "part")))
    spans = found.where(F.size("spans") > 0).select(*ROW, "spans")
    if not again.where("parts > 1").isEmpty():
        spans = spans.unionByName(_hot_spans(found.where("bytes is not null"), n))
    by_doc = spans.groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return _with_row(texts, by_doc, "left").select("doc_id", "text", "spans").mapInArrow(_finish(with_bytes), RESULT)


def _hot_spans(kinds: DataFrame, n: int) -> DataFrame:
    """``doc_id, t1, t2, spans`` of the kinds that the parts of larger buckets sent on."""
    sizes = materialize(kinds.groupBy("h").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")))
    members = kinds.drop("spans").join(sizes, "h").withColumn("part", F.pmod(F.xxhash64(*ROW, "at"), F.col("parts")).cast("int"))
    dealt = members.where("parts > 1")
    for side in ("before", "after"):
        known = shared_length(dealt.select("h", F.col(side).alias("context")))
        dealt = dealt.withColumnRenamed(side, "context").join(known, ["h", "context"]).drop("context").withColumnRenamed("ext", side)
    plain = members.where("parts = 1").withColumn("before", F.lit(REACH)).withColumn("after", F.lit(REACH))
    placed = plain.unionByName(dealt.select(*plain.columns))
    found = materialize(sort_parts(placed.repartition(n, "h", "part").sortWithinPartitions("h", "part")))
    # strings that are single in their part, but known to another one
    hot = found.where(F.size("strings") > 0).select(*ROW, F.arrays_zip("open", "strings").alias("z")).repartition(n).select(*ROW, F.explode("z").alias("z")).select(*ROW, "z.open", F.col("z.strings").alias("string"))
    shared = hot.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    late = hot.where("open >= 0").join(shared, "string", "left_semi").select(*ROW, F.array(F.col("open"), F.col("open") + 1).alias("spans"))
    return found.where(F.size("spans") > 0).select(*ROW, "spans").unionByName(late)


def _finish(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            spans = [x or [] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(_result(batch.column(0).to_pylist(), texts, spans, with_bytes), ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return run


#: The same rows by counting every string of the window's length, written in hex.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, {2 * WINDOW}) AS string FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS s FROM d)),
h AS (SELECT doc_id, s FROM w QUALIFY count(*) OVER (PARTITION BY string) > 1),
i AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WINDOW} THEN 1 ELSE 0 END AS new FROM h),
j AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM i),
g AS (SELECT doc_id, span, min(s) AS a, max(s) + {WINDOW} AS b FROM j GROUP BY ALL),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
