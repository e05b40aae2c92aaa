"""ISO media containers (ISO/IEC 14496-12): write, walk and describe without decoding payloads.

``describe`` walks the nested boxes, decodes the sample tables (stsd, stts, stss, stsc, stsz/stz2, stco/co64) and those
of movie fragments (trex, tfhd, trun), and reports for each track its codec, duration and the byte ranges of its sync
samples (keyframes). The duration is that of the edit list, else of the header, else (unknown there, or in fragments) the
sum of the samples'. Payload bytes are never decoded, only located. A file that is cut or malformed gives an error
text and what could be read, never an exception. ``wrap`` stores bytes losslessly as the samples of one track.

Null media count as empty bytes, which is an error ("no boxes"); repeated rows are described row by row; an empty
table gives an empty result; other columns are ignored. Box sizes of 64 bits and "to the end" are followed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import keyed_text, prepare, text_bytes

#: Bytes of one sample, samples of one chunk, samples from one keyframe to the next, samples per second.
SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 64, 16, 8, 125
#: Boxes that hold boxes, by the bytes before the first of them (fixed values of the format).
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
MAX_DEPTH = 16
MAX_SAMPLES = 1 << 28


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    number: int = 0
    timescale: int = 0
    #: Of the media header; 0 if unknown.
    duration: int = 0
    #: Of the edit list's segments, in the movie's time scale.
    edited: int = 0
    movie_scale: int = 0
    time_deltas: list[tuple[int, int]] = field(default_factory=list)
    sync: np.ndarray | None = None
    table_sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    per_chunk: list[tuple[int, int]] = field(default_factory=list)
    #: Duration, size and flags of a fragment's samples where it says nothing else.
    defaults: tuple[int, int, int] = (0, 0, 0)
    #: ``(offsets, sizes, sync, ticks)`` of each run of a fragment.
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=list)
    #: All samples, once ``resolve`` has put them together: first byte, length, numbers of the keyframes.
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def table_offsets(self) -> np.ndarray:
        """Byte offset of each sample of the tables, from its chunk and the sizes of those before it in the chunk."""
        n, k = len(self.table_sizes), len(self.chunks)
        if not n or not k or not self.per_chunk:
            return np.zeros(0, np.int64)
        first = np.array([a - 1 for a, _ in self.per_chunk])
        count = np.array([c for _, c in self.per_chunk], np.int64)
        in_chunk = count[np.clip(np.searchsorted(first, np.arange(k), side="right") - 1, 0, None)]
        chunk_of = np.repeat(np.arange(k), in_chunk)[:n]
        if len(chunk_of) < n:
            raise ValueError("samples without a chunk")
        before = np.cumsum(self.table_sizes) - self.table_sizes
        begins = np.minimum(np.cumsum(in_chunk) - in_chunk, n - 1)
        return self.chunks[chunk_of] + before - before[begins[chunk_of]]

    def resolve(self) -> None:
        """Samples of the tables, then of the fragments. Without a sync table each sample of the tables is a keyframe."""
        at = self.table_offsets()
        n = len(at)
        keys = np.arange(n) if self.sync is None else self.sync[(self.sync >= 0) & (self.sync < n)]
        sync = np.concatenate([np.isin(np.arange(n), keys), *(r[2] for r in self.runs)]).astype(bool)
        self.at = np.concatenate([at, *(r[0] for r in self.runs)]).astype(np.int64)
        self.sizes = np.concatenate([self.table_sizes[:n], *(r[1] for r in self.runs)]).astype(np.int64)
        self.keys = np.flatnonzero(sync)

    def key_ranges(self) -> list[tuple[int, int]]:
        """``(first byte, length)`` of each keyframe."""
        return list(zip(self.at[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))

    def seconds(self) -> float:
        if self.edited and self.movie_scale:
            return self.edited / self.movie_scale
        ticks = self.duration if self.duration and not self.runs else sum(n * d for n, d in self.time_deltas) + sum(r[3] for r in self.runs)
        return ticks / self.timescale if self.timescale else 0.0


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A file with one track whose samples of ``SAMPLE`` bytes (8-bit values, entry ``raw ``) are the payload."""
    n = len(payload) // SAMPLE
    if n * SAMPLE != len(payload) or not n:
        raise ValueError("the payload is not a positive multiple of the sample size")
    chunks, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    keys = range(1, n + 1, KEY_EVERY)
    big = len(payload) + 8 >= 1 << 32
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    first = len(head) + (16 if big else 8)
    places = range(first, first + len(payload), SAMPLE * PER_CHUNK)
    table = (full(b"co64", struct.pack(f">I{len(places)}Q", len(places), *places)) if big or places[-1] >= 1 << 32 else full(b"stco", struct.pack(f">I{len(places)}I", len(places), *places)))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, RATE * SAMPLE << 16 & 0xFFFFFFFF))
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, c, 1) for a, c in runs)), full(b"stsz", struct.pack(">II", SAMPLE, n)), table,
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", b""), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), MATRIX, bytes(8), flags=7)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return head + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(kind, first byte of the body, end)`` of the boxes that stand side by side."""
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} bytes left over at {start}")
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            if end - body < 8:
                raise ValueError(f"box cut at {start}")
            n, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif n == 0:
            n = end - start
        if kind == b"uuid":
            body += 16
        if start + n > end or body > start + n:
            raise ValueError(f"box {kind!r} at {start} has a wrong size")
        yield kind, body, start + n
        start += n


def _array(data: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    if n < 0 or at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _read(track: Track, kind: bytes, data: memoryview, at: int, end: int) -> None:
    """One box of a track's tables."""
    version = data[at] if at < end else 0
    if kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if version == 1 else struct.unpack_from(">II", data, at + 12)
        if track.duration == (1 << (64 if version == 1 else 32)) - 1:
            track.duration = 0  # unknown
    elif kind == b"tkhd":
        track.number = struct.unpack_from(">I", data, at + (20 if version == 1 else 12))[0]
    elif kind == b"elst":
        n, entry = struct.unpack_from(">I", data, at + 4)[0], ">QqI" if version == 1 else ">IiI"
        if at + 8 + n * struct.calcsize(entry) > end:
            raise ValueError("a table is longer than its box")
        track.edited = sum(struct.unpack_from(entry, data, at + 8 + k * struct.calcsize(entry))[0] for k in range(n))
    elif kind == b"hdlr":
        track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind == b"stts":
        pairs = _array(data, at + 8, end, ">u4", 2 * struct.unpack_from(">I", data, at + 4)[0])
        track.time_deltas = list(zip(pairs[::2].tolist(), pairs[1::2].tolist(), strict=True))
    elif kind == b"stss":
        track.sync = _array(data, at + 8, end, ">u4", struct.unpack_from(">I", data, at + 4)[0]) - 1
    elif kind == b"stsc":
        rows = _array(data, at + 8, end, ">u4", 3 * struct.unpack_from(">I", data, at + 4)[0])
        track.per_chunk = list(zip(rows[::3].tolist(), rows[1::3].tolist(), strict=True))
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if n > MAX_SAMPLES:
            raise ValueError("too many samples")
        track.table_sizes = np.full(n, size, np.int64) if size else _array(data, at + 12, end, ">u4", n)
    elif kind == b"stz2":
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            packed = _array(data, at + 12, end, "u1", (n + 1) // 2)
            track.table_sizes = np.stack([packed >> 4, packed & 15], 1).ravel()[:n]
        else:
            track.table_sizes = _array(data, at + 12, end, ">u2" if bits == 16 else "u1", n)
    elif kind in (b"stco", b"co64"):
        track.chunks = _array(data, at + 8, end, ">u4" if kind == b"stco" else ">u8", struct.unpack_from(">I", data, at + 4)[0])


class Fragment:
    """What holds inside one moof: its place, and of the current traf the track, its defaults and where data goes on."""

    #: Flag bits of tfhd and trun (fixed values of the format), and the bit of a sample that is no sync sample.
    BASE, ENTRY, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
    RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
    NO_SYNC = 0x10000

    def __init__(self, moof: int):
        self.moof, self.track, self.defaults, self.base, self.goes_on = moof, None, (0, 0, 0), moof, moof

    def tfhd(self, tracks: list[Track], data: memoryview, at: int) -> None:
        flags, number = struct.unpack_from(">II", data, at)
        self.track = next((t for t in tracks if t.number == number), None)
        if self.track is None:
            raise ValueError(f"a fragment of track {number}, which there is not")
        own, at = list(self.track.defaults), at + 8
        # without a base of its own the first traf counts from the moof, another one from where the last data ended
        self.base = self.moof if flags & self.FROM_MOOF else self.goes_on
        if flags & self.BASE:
            self.base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        if flags & self.ENTRY:
            at += 4
        for k, bit in enumerate((self.DURATION, self.SIZE, self.FLAGS)):
            if flags & bit:
                own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
        self.defaults, self.goes_on = tuple(own), self.base

    def trun(self, data: memoryview, at: int, end: int) -> None:
        if self.track is None:
            raise ValueError("a run of samples without a track")
        flags, n = struct.unpack_from(">II", data, at)
        flags, at = flags & 0xFFFFFF, at + 8
        begin = self.goes_on
        if flags & self.RUN_OFFSET:
            begin, at = self.base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & self.RUN_FIRST:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        fields = [bit for bit in (self.RUN_DURATION, self.RUN_SIZE, self.RUN_FLAGS, self.RUN_SHIFT) if flags & bit]
        if n > MAX_SAMPLES:
            raise ValueError("too many samples")
        table = _array(data, at, end, ">u4", n * len(fields)).reshape(n, len(fields))
        column = lambda bit, k: table[:, fields.index(bit)] if bit in fields else np.full(n, self.defaults[k], np.int64)
        ticks, sizes, own = column(self.RUN_DURATION, 0), column(self.RUN_SIZE, 1), column(self.RUN_FLAGS, 2).copy()
        if first is not None and n and self.RUN_FLAGS not in fields:
            own[0] = first
        self.goes_on = begin + int(sizes.sum())
        self.track.runs.append((begin + np.cumsum(sizes) - sizes, sizes, own & self.NO_SYNC == 0, int(ticks.sum())))


def describe(media: bytes) -> tuple[list[Track], list[str], str]:
    """``(tracks, paths of boxes, error or "")``."""
    data, tracks, paths = memoryview(media), [], []
    extends: dict[int, tuple[int, int, int]] = {}
    movie_scale, fragment = 0, None

    def walk(start: int, end: int, path: str, depth: int) -> None:
        nonlocal movie_scale, fragment
        for kind, body, stop in boxes(data, start, end):
            name = f"{path}/{kind.decode('latin-1')}" if path else kind.decode("latin-1")
            paths.append(name)
            if kind == b"trak":
                tracks.append(Track())
            elif kind == b"moof":
                for t in tracks:
                    t.defaults = extends.get(t.number, t.defaults)
                fragment = Fragment(start)
            if kind in CONTAINERS:
                if depth >= MAX_DEPTH:
                    raise ValueError("boxes are nested too deeply")
                walk(min(stop, body + CONTAINERS[kind]), stop, name, depth + 1)
            elif kind == b"mvhd":
                movie_scale = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))[0]
            elif kind == b"trex":
                number, _, *own = struct.unpack_from(">IIIII", data, body + 4)
                extends[number] = tuple(own)
            elif kind == b"tfhd" and fragment:
                fragment.tfhd(tracks, data, body)
            elif kind == b"trun" and fragment:
                fragment.trun(data, body, stop)
            elif tracks and "/trak/" in name:
                _read(tracks[-1], kind, data, body, stop)
            start = stop

    try:
        if not media:
            raise ValueError("no boxes")
        walk(0, len(media), "", 0)
        for t in tracks:
            t.movie_scale = movie_scale
            t.resolve()
            if len(t.at) and (t.at.min() < 0 or (t.at + t.sizes).max() > len(media)):
                raise ValueError("a sample lies outside the file")
    except (ValueError, struct.error, IndexError) as e:
        return tracks, paths, str(e) or type(e).__name__
    return tracks, paths, ""


def payload_of(media: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order, found through its tables."""
    at = track.at
    if not len(at):
        return b""
    ends = at + track.sizes
    cut = np.flatnonzero(np.r_[True, at[1:] != ends[:-1]])  # neighbours are read as one run
    return b"".join(media[a:b] for a, b in zip(at[cut].tolist(), ends[np.r_[cut[1:] - 1, len(at) - 1]].tolist(), strict=True))


def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the sample size."""
    return text + bytes(-len(text) % SAMPLE if text else SAMPLE)


TRACKS = "array<struct<codec:string,handler:string,timescale:long,duration:long,seconds:double,n_samples:long,keyframes:array<struct<offset:long,length:long>>>>"


def media_columns(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id, media_bytes, boxes array<string>, tracks array<struct>, error`` of binary ISO media files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tracks, paths, error = describe(m or b"")
                rows = [] if error else [{"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "seconds": t.seconds(), "n_samples": len(t.sizes), "keyframes": [{"offset": a, "length": n} for a, n in t.key_ranges()]} for t in tracks]
                out.append({"doc_id": i, "media_bytes": len(m or b""), "boxes": paths, "tracks": rows, "error": error or None})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    key = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(key))])
    SCHEMA = pa.schema([("doc_id", pa.int64()), ("media_bytes", pa.int64()), ("boxes", pa.list_(pa.string())), ("tracks", pa.list_(track)), ("error", pa.string())])  # noqa: N806
    prepare(files.sparkSession)
    return files.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").cast("binary").alias("media")).mapInArrow(run, f"doc_id long, media_bytes long, boxes array<string>, tracks {TRACKS}, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media binary``: each text, padded, as an ISO media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            raw, o = data.tobytes(), offs.tolist()
            for first in range(0, batch.num_rows, 256):
                rows = range(first, min(first + 256, batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array([o[k + 1] - o[k] for k in rows], pa.int64()), pa.array([wrap(padded(raw[o[k] : o[k + 1]])) for k in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    prepare(docs.sparkSession)
    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_features(stored: DataFrame) -> DataFrame:
    """Reads back what ``store_texts`` made: digests of payload and file, and the track's features as one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                media = batch.column(2)[k].as_py()
                tracks, _, error = describe(media)
                if error or len(tracks) != 1:
                    raise ValueError(f"a stored file can't be read back: {error or len(tracks)}")
                t = tracks[0]
                payload, keys = payload_of(media, t), t.key_ranges()
                feature = f"codec={t.codec.strip()};seconds={t.seconds():.3f};samples={len(t.sizes)};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges_crc32={zlib.crc32(repr(keys).encode())}"
                rows.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], kind) for kind in kinds], names)

    prepare(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
