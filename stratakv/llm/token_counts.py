"""Token counts by overlap resynchronisation.

A text of ordinary length is encoded whole by the tokenizers library. A huge one is encoded as chunks that
overlap, with offsets; two neighbouring encodings are spliced at a token boundary that is *proven* stable:
the pre-tokenizer splits there whatever stands further away (``stable``), both chunks have the boundary, and they
agree on the token after it. The proof needs only the classes of the two characters around the place, so the splice is
chosen before anything is encoded: where an overlap holds no such place it is doubled, up to half a chunk, and then
the chunk grows forward to the next one. So no part is encoded again from its start: what is encoded twice is the
overlaps, and memory per call is bounded by the chunk, unless the places lie further apart (one pre-token of that size).

The classes are those on which all versions of Unicode since 3.2 agree. A file whose pre-tokenizer is not the byte-level
one with its own pattern, or whose special strings take white space with them, proves no place: texts are encoded whole.

Nulls count as empty (0 bytes, 0 tokens); ties and repeated rows are counted row by row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import keyed_text, prepare, texts_of

#: Characters of one chunk, and of the first overlap tried.
CHUNK = 1 << 15
OVERLAP = 1 << 10
LIMIT = 512
#: Texts that one library call gets at once.
CALL_CHARS = 2_000_000

Spans = list[tuple[int, int, int]]


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def library_spans(path: str) -> Callable[[str], Spans]:
    """``text -> [(id, start, end)]`` in characters, by the library."""

    def spans(text: str) -> Spans:
        e = tokenizer(path).encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    return spans


#: Places after a letter, digit or mark that are likely stable; ``stable`` decides.
_LIKELY = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|[^\s\p{L}\p{N}'](?=[\s\p{L}\p{N}])")


@cache
def kind_of(char: str) -> str:
    """L letter, N number, S white space, O any other; "" where versions of Unicode may differ."""
    now, then = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if char in " \n\r\t\x0b\x0c":
        return "S"
    return "" if now[0] != then[0] or now[0] in "CZ" else now[0] if now[0] in "LN" else "O"


def stable(text: str, at: int, specials: tuple[str, ...] = ()) -> bool:
    """Whether the pre-tokenizer splits before ``at`` whatever stands further away, so that both sides encode alone.

    Its pattern takes runs of letters, of digits and of other marks, each with at most one space before it, and runs of
    white space. A run of letters, digits or marks always ends where the next character is of another class, at the
    text's end too; only an apostrophe before letters may start a contraction instead. It looks ahead at white space only.
    A special string that reaches over ``at`` unmakes the place.
    """
    if not 1 <= at < len(text):
        return False
    a, b = kind_of(text[at - 1]), kind_of(text[at])
    if not a or not b or a == b or a == "S" or (text[at - 1] == "'" and b == "L"):
        return False
    return not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in specials)


@cache
def proves(path: str) -> bool:
    """Whether the file's pre-tokenizer is the one that ``stable`` knows, without a normaliser before it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    plain = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    return plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")


def splice_after(text: str, start: int, chunk: int, overlap: int, specials: tuple[str, ...] = ()) -> int | None:
    """Where the chunk that begins at ``start`` is spliced to the next: the last stable place in the overlap at its end.

    Without one the overlap doubles, up to half the chunk; then the first stable place after the chunk; None if
    the rest of the text has none.
    """
    end, wide, tried = start + chunk, min(overlap, chunk // 2), start + chunk
    while True:
        for m in reversed(list(_LIKELY.finditer(text, max(start, end - wide) - 1 if end - wide > start else start, tried))):
            if start < m.end() and stable(text, m.end(), specials):
                return m.end()
        if wide >= chunk // 2:
            break
        tried, wide = end - wide + 1, min(2 * wide, chunk // 2)
    for m in _LIKELY.finditer(text, max(start, end - 1)):
        if stable(text, m.end(), specials):
            return m.end()
    return None


def count_huge(text: str, spans: Callable[[str], Spans], specials: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, from encodings of chunks that overlap."""
    n, total, start, begin = len(text), 0, 0, 0
    known: Spans = []  # the tokens from ``start`` to the last stable place of the overlap, as the chunk before has them
    while True:
        cut = splice_after(text, start, chunk, overlap, specials) if n - start > chunk + overlap else None
        stop = n if cut is None else min(n, cut + overlap)
        while True:
            own = [(i, begin + a, begin + b) for i, a, b in spans(text[begin:stop])]
            at = next((k for k, x in enumerate(own) if x[1] >= start), len(own))
            if not start or (at < len(own) and own[at][1] == start and own[at : at + len(known)] == known):
                break
            if not begin:
                raise ValueError("chunks don't align at a place that was proven stable")
            begin = max(0, begin - 2 * (start - begin))  # alignment fails: a wider overlap
        if cut is None:
            return total + len(own) - at
        end = next(k for k, x in enumerate(own) if x[1] >= cut)
        total += end - at
        sure = max((m.end() for m in _LIKELY.finditer(text, cut, stop) if cut < m.end() < stop and stable(text, m.end(), specials)), default=cut)
        known = [x for x in own[end:] if x[1] < sure]
        start, begin = cut, max(0, cut - overlap)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunked`` for each row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, specials, spans, in_chunks = tokenizer(tokenizer_path), special_strings(tokenizer_path), library_spans(tokenizer_path), proves(tokenizer_path)
        for batch in batches:
            texts, tokens = texts_of(batch.column(1)), [0] * batch.num_rows
            group: list[int] = []
            held = 0
            for k, text in enumerate([*texts, None]):
                if group and (text is None or held + len(text) > CALL_CHARS):
                    for j, e in zip(group, t.encode_batch_fast([texts[j] for j in group], add_special_tokens=False), strict=True):
                        tokens[j] = len(e)
                    group, held = [], 0
                if text is None:
                    break
                if in_chunks and len(text) > 2 * chunk:
                    tokens[k] = count_huge(text, spans, specials, chunk, overlap)
                else:
                    group.append(k)
                    held += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([in_chunks and len(x) > 2 * chunk for x in texts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "chunked"])

    prepare(docs.sparkSession)
    out = keyed_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, chunked boolean")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
