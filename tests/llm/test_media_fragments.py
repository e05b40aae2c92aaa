"""Movie fragments, edit lists, unknown durations, and an independent reader of what the query stores."""

import hashlib
import struct
import zlib

from stratakv.llm import media, queries
from stratakv.llm.media import box, full


def moov(*extra, duration=0, edits=b""):
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, duration, 0, 0)), box(b"minf", stbl))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 3, 0, 0))
    return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, 600, 0)), box(b"trak", tkhd, edits, mdia), *extra)


def test_fragments_are_located():
    trex = box(b"mvex", full(b"trex", struct.pack(">IIIII", 3, 1, 40, 5, 0x10000)))
    head = box(b"ftyp", b"isom", bytes(4)) + moov(trex)

    def moof(offset):
        # the first run: sizes of its own, the first sample a keyframe; the second run goes on with the defaults
        one = full(b"trun", struct.pack(">IiI", 3, offset, 0), struct.pack(">III", 7, 8, 9), flags=0x205)
        two = full(b"trun", struct.pack(">I", 2))
        return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 3), flags=0x20000), one, two))

    data = bytes(range(34))
    m = moof(0)
    m = head + moof(len(m) + 8) + box(b"mdat", data) + moof(len(m) + 8) + box(b"mdat", data)
    (t,), paths, error = media.describe(m)
    assert not error and "moof/traf/trun" in paths and t.codec == "avc1"
    assert [m[a : a + n] for a, n in zip(t.at.tolist(), t.sizes.tolist(), strict=True)] == [data[:7], data[7:15], data[15:24], data[24:29], data[29:]] * 2
    assert t.keys.tolist() == [0, 5] and t.seconds() == 0.4
    assert [m[a : a + n] for a, n in t.key_ranges()] == [data[:7]] * 2
    assert media.describe(m[:-40])[2] and media.describe(head + box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 9)))))[2] == "a fragment of track 9, which there is not"


def test_edit_lists_and_unknown_durations():
    edits = box(b"edts", full(b"elst", struct.pack(">I", 2), struct.pack(">IiI", 300, -1, 0x10000), struct.pack(">IiI", 600, 0, 0x10000)))
    head = box(b"ftyp", b"isom", bytes(4))
    assert media.describe(head + moov(duration=5000))[0][0].seconds() == 5.0
    assert media.describe(head + moov(duration=5000, edits=edits))[0][0].seconds() == 1.5
    assert media.describe(head + moov(duration=0xFFFFFFFF))[0][0].seconds() == 0.0


def read_plainly(file):
    """The samples' bytes of a file with one track, by looking for the tables' names alone."""
    at = lambda kind: file.rindex(kind) + 8  # noqa: E731 - after the name, version and flags
    size, n = struct.unpack_from(">II", file, at(b"stsz"))
    (k,) = struct.unpack_from(">I", file, at(b"stco"))
    chunks = struct.unpack_from(f">{k}I", file, at(b"stco") + 4)
    (r,) = struct.unpack_from(">I", file, at(b"stsc"))
    runs = [struct.unpack_from(">III", file, at(b"stsc") + 4 + 12 * i) for i in range(r)]
    out = b""
    for i, place in enumerate(chunks, 1):
        per = [c for first, c, _ in runs if first <= i][-1]
        out += file[place : place + per * size]
    assert len(out) == n * size
    return out


def test_stored_texts_by_another_reader(spark, tmp_path):
    texts = {1: "some text", 2: None, 3: "é" * 5000, 4: "x" * 64, 5: "stsz stco stsc moov" * 90, 6: ""}
    spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = {r.doc_id: bytes(r.media) for r in media.store_texts(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    got = {r.doc_id: r for r in queries.op10_media(spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert read_plainly(files[i]) == payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert got[2].feature == got[6].feature
