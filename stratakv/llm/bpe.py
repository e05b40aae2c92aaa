"""BPE encoding and decoding with segment trees over adjacent pair ranks.

Each word is a list of symbols; the leaves of its segment tree hold ``rank << POS_BITS | place`` of the pairs of
neighbours, inner nodes the least of their two children. The root is thus the leftmost pair of lowest rank: it
is merged, and the at most three leaves that change are put right in logarithmic time, until no pair merges.
The trees of all new words of a batch are kept as rows of one numpy matrix (by width), so a step of the loop
merges one pair in every word at once. A word of more than ``ALONE`` bytes has a tree of its own, whose updates
stop at the first node that they don't change.

The vocabulary file is read as published (vocabulary, merges, special strings); nothing is trained. The normaliser and
the split pattern are those of this kind of file, written out here; a file that names others is refused.
Nulls count as empty (no ids, empty decoded text); repeated rows are encoded row by row; an empty table gives an
empty result; other columns are ignored. A word of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import KEPT, keyed_text, lean, prepare, texts_of

POS_BITS = 28
NONE = np.int64(1) << 62
#: Words kept with their encodings by a worker, and the longest such word. Both bound memory only.
CACHED_WORDS, CACHED_CHARS = 150_000, 48
#: Cells (rows x width) of one matrix of trees, and the longest word (in bytes) that shares one.
CELLS, ALONE = 1 << 19, 256
#: White space of the file's patterns: the Unicode property of this name.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: What the file must name (fixed values of this kind of file): steps of its normaliser, its split pattern, its byte step.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def refuse_others(spec: dict) -> None:
    """Only files whose text is normalised and split as ``Codec.words`` does it."""
    model, steps, parts = spec["model"], (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    splits = parts[0].get("pattern") == {"Regex": SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    as_bytes = parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    special = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (model["type"] == "BPE" and plain and steps == NORMALIZER and len(parts) == 2 and splits and as_bytes and special and spec["decoder"] is None):
        raise ValueError("the vocabulary file names another normaliser, split pattern, decoder or kind of model")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one published word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[v[a] << 32 | v[b]] = rank  # a later line of the same pair counts, as in a map
        self.pairs = pairs
        self._hash(pairs)
        self.merged = np.array([v[a + b] for a, b in merges], np.int64)
        chars = byte_chars()
        self.inner = np.array([v[c] for c in chars], np.int64)
        self.last = np.array([v[c + self.suffix] for c in chars], np.int64)
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.known: dict[str, tuple[tuple[int, ...], str, str]] = {}

    # -- words ---------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special strings: NFC, lower case letter by letter, split."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule here
        return self.split.findall(text.lower())

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """``(is_special, part)``: special strings stand alone and are found before normalisation."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield False, text
            return
        for k, part in enumerate(self.special_split.split(text)):
            if part:
                yield k % 2 == 1, part

    # -- segment trees -------------------------------------------------------------------------------------

    def _hash(self, pairs: dict[int, int]) -> None:
        """The pairs in an open-addressed table of arrays, at a load under an eighth."""
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.slot_keys, self.slot_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, ranks = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_keys[at[left]] == -1
            _, one = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            one = one[free[one]]
            self.slot_keys[at[left[one]]], self.slot_ranks[at[left[one]]] = keys[left[one]], ranks[left[one]]
            left = np.delete(left, one)
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a << 32 | b
        at = self._slot(key)
        there = self.slot_keys[at]
        out = np.where(there == key, self.slot_ranks[at], -1)
        todo = np.flatnonzero((there != key) & (there != -1))
        at = at.ravel()[todo]
        while len(todo):
            at = at + 1 & (1 << self.bits) - 1
            there = self.slot_keys[at]
            hit = there == key.ravel()[todo]
            out.ravel()[todo[hit]] = self.slot_ranks[at[hit]]
            more = ~hit & (there != -1)
            todo, at = todo[more], at[more]
        return out

    def merge(self, sym: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Ids of many words at once. ``sym``: (words, width) first symbols; ``size``: symbols of each word."""
        n, width = sym.shape
        leaves = 1 << max(0, (width - 1).bit_length())
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        if width > 1:
            r = self.ranks(np.ascontiguousarray(sym[:, :-1]), sym[:, 1:])
            r[(place[:-1] + 1)[None, :] >= size[:, None]] = -1
            tree[:, leaves : leaves + width - 1] = np.where(r >= 0, r << POS_BITS | place[:-1], NONE)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        nxt = np.broadcast_to(place + 1, (n, width)).copy().ravel()
        prv = np.broadcast_to(place - 1, (n, width)).copy().ravel()
        alive = np.arange(width)[None, :] < size[:, None]
        live, flat_sym, flat = alive.ravel(), sym.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * leaves) + 1]
            go = root < NONE
            rows, root = rows[go], root[go]
            if not len(rows):
                break
            base, top = rows * width, rows * (2 * leaves)
            left = root & ((1 << POS_BITS) - 1)
            right = nxt[base + left]
            after, before = nxt[base + right], prv[base + left]
            new = self.merged[root >> POS_BITS]
            flat_sym[base + left] = new
            nxt[base + left] = after
            live[base + right] = False
            inside = np.flatnonzero(after < size[rows])
            at = base[inside] + after[inside]
            prv[at] = left[inside]
            r = self.ranks(new[inside], flat_sym[at])
            value = np.full(len(rows), NONE, np.int64)
            value[inside] = np.where(r >= 0, r << POS_BITS | left[inside], NONE)
            flat[top + leaves + right] = NONE
            flat[top + leaves + left] = value
            some = np.flatnonzero(before >= 0)
            r = self.ranks(flat_sym[base[some] + before[some]], new[some])
            flat[top[some] + leaves + before[some]] = np.where(r >= 0, r << POS_BITS | before[some], NONE)
            self._up(flat, leaves, top, right)
            self._up(flat, leaves, top, left)
            self._up(flat, leaves, top[some], before[some])
        ids, ends = sym[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _up(flat: np.ndarray, leaves: int, top: np.ndarray, at: np.ndarray) -> None:
        """After one leaf of each tree changed: the least of two children anew, from there up to the root."""
        node = at + leaves
        while leaves > 1:
            node = node >> 1
            child = top + 2 * node
            flat[top + node] = np.minimum(flat[child], flat[child + 1])
            leaves >>= 1

    def merge_alone(self, symbols: np.ndarray) -> list[int]:
        """Ids of one long word, by plain numbers: a merge touches a few nodes of the tree, too few for numpy."""
        n, none, rank_of, merged, low = len(symbols), int(NONE), self.pairs.get, self.merged.tolist(), (1 << POS_BITS) - 1
        leaves = 1 << (n - 1).bit_length()
        first = np.full(2 * leaves, NONE, np.int64)
        r = self.ranks(symbols[:-1], symbols[1:])
        first[leaves : leaves + n - 1] = np.where(r >= 0, r << POS_BITS | np.arange(n - 1), NONE)
        level = leaves
        while level > 1:
            first[level // 2 : level] = np.minimum(first[level : 2 * level : 2], first[level + 1 : 2 * level : 2])
            level //= 2
        # arrays of machine numbers: memory is 40 bytes for each byte of the word
        tree, sym = array("q", first.tobytes()), array("q", symbols.astype(np.int64).tobytes())
        nxt, prv = array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())

        def put(at: int, value: int) -> None:
            at += leaves
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        while (root := tree[1]) < none:
            left = root & low
            right = nxt[left]
            after, before = nxt[right], prv[left]
            sym[left] = new = merged[root >> POS_BITS]
            sym[right] = -1
            nxt[left] = after
            value = none
            if after < n:
                prv[after] = left
                if (rank := rank_of(new << 32 | sym[after])) is not None:
                    value = rank << POS_BITS | left
            put(left, value)
            if tree[leaves + right] != none:
                put(right, none)
            if before >= 0:
                rank = rank_of(sym[before] << 32 | new)
                value = none if rank is None else rank << POS_BITS | before
                if tree[leaves + before] != value:
                    put(before, value)
        return [x for x in sym if x >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words; words of like length share a matrix, long ones have a tree each."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, list[int]] = {}
        for w in words:
            b = w.encode("utf-8", "replace")
            if len(b) > ALONE:
                raw = np.frombuffer(b, np.uint8)
                out[w] = self.merge_alone(np.append(self.inner[raw[:-1]], self.last[raw[-1]]))
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((w, b))
        for width, group in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                size = np.array([len(b) for _, b in part], np.int64)
                raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in part), np.uint8).reshape(len(part), width)
                sym = self.inner[raw]
                sym[np.arange(len(part)), size - 1] = self.last[raw[np.arange(len(part)), size - 1]]
                out.update(zip((w for w, _ in part), self.merge(sym, size), strict=True))
        return out

    # -- texts ---------------------------------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens stand as they are, with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def _word_table(self, texts: list[list[tuple[bool, list[str] | str]]]) -> dict[str, tuple[tuple[int, ...], str, str]]:
        known, fresh = self.known, set()
        for parts in texts:
            for special, words in parts:
                if not special:
                    fresh.update(words)
        if len(known) > CACHED_WORDS:  # those in use now are kept
            known = self.known = {w: known[w] for w in fresh if w in known}
        fresh.difference_update(known)
        made = {}
        for w, ids in self.encode_words(fresh).items():
            made[w] = (tuple(ids), " ".join(map(str, ids)), self.decode(ids))
        short = {w: x for w, x in made.items() if len(w) <= CACHED_CHARS}
        known.update(short)
        return known if len(short) == len(made) else {**known, **made}

    def round_trips(self, texts: list[str], with_ids: bool = True) -> list[tuple[list[int] | None, int, str, str]]:
        """``(ids, number of ids, ids as decimals joined by a space, decoded text)`` of each text."""
        split = [[(special, part if special else self.words(part)) for special, part in self.pieces(x)] for x in texts]
        table, out = self._word_table(split), []
        for parts in split:
            found = []
            for special, words in parts:
                if special:
                    i = self.special[words]
                    found.append(((i,), str(i), self.tokens[i]))
                else:
                    found.extend(map(table.__getitem__, words))
            joined = " ".join([x[1] for x in found])
            out.append(([i for x in found for i in x[0]] if with_ids else None, joined.count(" ") + 1 if joined else 0, joined, " ".join([x[2] for x in found])))
        return out

    def encode(self, text: str) -> list[int]:
        return self.round_trips([text])[0][0]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


KEPT["bpe"] = codec.cache_clear


def runs(texts: list[str], limit: int = 500_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters, so that memory follows the limit and not the batch."""
    part: list[str] = []
    held = 0
    for x in texts:
        if part and held + len(x) > limit:
            yield part
            part, held = [], 0
        part.append(x)
        held += len(x)
    if part:
        yield part


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``doc_id, n_tokens`` and the named outputs of each row.

    ``ids`` array<int>; ``decoded`` the text decoded from them; ``ids_sha256`` and ``decoded_sha256`` are hex
    digests of the ids (decimals joined by a space) and of the decoded text, taken in the worker from these very
    values so that the long columns need not travel when only digests are wanted.
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            first = 0
            for part in runs(texts_of(batch.column(1))):
                done = c.round_trips(part, "ids" in outputs)
                made = {"ids": lambda: [x[0] for x in done], "decoded": lambda: [x[3] for x in done], "ids_sha256": lambda: [hashlib.sha256(x[2].encode()).hexdigest() for x in done], "decoded_sha256": lambda: [hashlib.sha256(x[3].encode()).hexdigest() for x in done]}  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array([x[1] for x in done], pa.int64()), *(pa.array(made[o](), kinds[o][1]) for o in outputs)], ["doc_id", "n_tokens", *outputs])
                first += len(part)

    prepare(docs.sparkSession)
    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long" + "".join(f", {o} {kinds[o][0]}" for o in outputs))


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of rows that hold ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(lean(run, "bpe"), "doc_id long, decoded string")
