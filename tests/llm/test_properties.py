"""Random inputs: splices, merges, containers and removed ranges hold for any text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from stratakv.llm import bpe, media, suffixes, token_counts
from stratakv.llm.queries import vocabulary

HARD = st.lists(st.sampled_from([" ", "  ", "a", "the ", " and", "'s", "'", "\n", "é", "日本", "<|endoftext|>", "<|", "12", "!", "x y z ", "\t"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(HARD, st.integers(10, 60), st.integers(1, 12))
def test_splices(text, chunk, overlap):
    path = vocabulary("byte_bpe_50k.json")
    whole = len(token_counts.tokenizer(path).encode(text, add_special_tokens=False).ids)
    assert token_counts.count_huge(text, token_counts.library_spans(path), token_counts.special_strings(path), chunk, overlap) == whole


@settings(max_examples=150, deadline=None)
@given(st.one_of(HARD, st.text(max_size=80)).filter(lambda x: x.isprintable() or x.isascii()))
def test_encodings(text):
    path = vocabulary("word_bpe_49k.json")
    e = token_counts.tokenizer(path).encode(text, add_special_tokens=False)
    c = bpe.codec(path)
    assert c.encode(text) == e.ids and c.round_trips([text])[0][3] == token_counts.tokenizer(path).decode(e.ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_containers(data):
    payload = media.padded(data)
    m = media.wrap(payload)
    tracks, _, error = media.describe(m)
    assert not error and media.payload_of(m, tracks[0]) == payload
    media.describe(data)  # any bytes: an error text at worst


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 900), st.lists(st.tuples(st.integers(0, 600), st.integers(1, 60)), max_size=8))
def test_covered_ranges(extra, starts):
    size = max([s + n - 1 + suffixes.WINDOW for s, n in starts], default=0) + extra
    text = bytes(k % 251 for k in range(size))
    flags = bytearray(size)
    for s, n in starts:
        flags[s : s + n - 1 + suffixes.WINDOW] = b"\1" * (n - 1 + suffixes.WINDOW)
    gone = suffixes.covered([x for s, n in starts for x in (s, s + n)], size)
    assert suffixes.without(text, gone) == bytes(b for b, f in zip(text, flags, strict=True) if not f)
    assert len(gone) == sum(flags[k] and (k == 0 or not flags[k - 1]) for k in range(size))
