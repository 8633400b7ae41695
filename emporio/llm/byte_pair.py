"""Operator 11, BPE encoding and decoding: byte-pair merges on a contiguous rank array.

A word is held as the list of its parts and, beside it, the list of the
ranks of neighbouring parts.  The least rank is looked for by a scan, its
boundary is deleted from both lists, and the ranks to its left and right
are read anew, until no neighbours have a rank.  A scan beats a heap for
short words; above ``LONG_WORD`` bytes the same merges are made from a
heap of (rank, place), which isn't quadratic.

Texts are split into words by the pattern of byte-level BPE, and the
strings of added tokens stand for themselves.  Words and stretches
between spaces are cached in each worker.  Decoding writes the bytes of
the ids one after another; bytes that aren't UTF-8 become U+FFFD.

Defined results: a NULL or empty text has no ids and decodes to an empty
text; every row is coded on its own, repeated ones too; all columns come
through, the new ones under a fresh name; an empty table gives no rows.
An id outside the vocabulary raises an error.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .packing import printable_bytes, simple

#: Rank of neighbours that don't merge.
NONE = 1 << 40
#: Bytes up to which a word's ranks are scanned.
LONG_WORD = 256
#: Characters of a cached stretch, and entries of a worker's caches before they are emptied.
CACHED_CHARS, CACHE_WORDS = 48, 1_000_000
#: The pattern of byte-level BPE on ASCII text, where no two Unicode versions differ; white space is U+0009 to U+000D and blank.
ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Rows of a batch that leaves a worker.
ROWS = 2_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A byte-level BPE file: merges by ids, bytes of each id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
               if model.get(k)]
        split = spec.get("pre_tokenizer") or {}
        if (odd or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
                or not split.get("use_regex", True)
                or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        shown, vocab = printable_bytes(), model["vocab"]
        self.bits = max(vocab.values()).bit_length()
        self.pair, self.made = {}, []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pair.setdefault(vocab[a] << self.bits | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.single = [0] * 256
        for c, byte in shown.items():
            self.single[byte] = vocab[c]
        self.added = {t["content"]: t["id"] for t in added}
        spelled = {i: bytes(shown[c] for c in w) for w, i in vocab.items() if w not in self.added}
        spelled |= {i: w.encode() for w, i in self.added.items()}
        self.spelled = [spelled.get(i) for i in range(max(spelled) + 1)]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel
        self.vocab = v = Vocabulary(path)
        # the library's own splitter: others know letters and digits of another Unicode version
        self.cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.split = re.compile("(%s)" % "|".join(map(re.escape, sorted(v.added, key=len, reverse=True)))).split
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def find(self, t: str) -> list[str]:
        """The words of a text: the library is called for text beyond ASCII only, as a call costs more than most stretches."""
        if t.isascii():
            return ASCII_WORDS.findall(t)
        return [t[a:b] for _, (a, b) in self.cuts(t)]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: parts and the ranks of neighbours, the least one first."""
        v = self.vocab
        if len(word) > LONG_WORD:
            return self.merged_long(word)
        rank_of, made, bits = v.pair.get, v.made, v.bits
        part = [v.single[b] for b in word]
        rank = [rank_of(a << bits | b, NONE) for a, b in pairwise(part)]
        while rank:
            low = min(rank)
            if low == NONE:
                break
            i = rank.index(low)
            part[i] = new = made[low]
            del part[i + 1], rank[i]
            if i:
                rank[i - 1] = rank_of(part[i - 1] << bits | new, NONE)
            if i < len(rank):
                rank[i] = rank_of(new << bits | part[i + 1], NONE)
        return part

    def merged_long(self, word: bytes) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        v = self.vocab
        part = [v.single[b] for b in word]
        n = len(part)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int) -> int:
            j = right[i]
            return v.pair.get(part[i] << v.bits | part[j], NONE) if j < n else NONE

        heap = [(r, i) for i in range(n) if (r := rank(i)) != NONE]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            if part[i] is None or rank(i) != low:  # one of the two has merged meanwhile
                continue
            j = right[i]
            part[i], part[j], right[i] = v.made[low], None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (r := rank(k)) != NONE:
                    heapq.heappush(heap, (r, k))
        return [p for p in part if p is not None]

    def word(self, w: str) -> bytes:
        out = self.words.get(w)
        if out is None:
            out = array("I", self.merged(w.encode())).tobytes()
            if len(w) <= CACHED_CHARS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[w] = out
        return out

    def stretch(self, w: str) -> bytes:
        """Ids of a space and what follows it, up to the next space."""
        out = b"".join(map(self.word, self.find(" " + w)))
        if len(w) <= CACHED_CHARS:
            if len(self.stretches) >= CACHE_WORDS:
                self.stretches.clear()
            self.stretches[w] = out
        return out

    def plain(self, t: str) -> bytes:
        """Ids of a text without added tokens."""
        if not simple(t):
            return b"".join(map(self.word, self.find(t)))
        first, *rest = t.split(" ")  # the pattern begins a word at each of these spaces
        known, new = self.stretches.get, self.stretch
        return b"".join(map(self.word, self.find(first))) + b"".join([known(w) or new(w) for w in rest])

    def __call__(self, t: str) -> bytes:
        if not any(a in t for a in self.vocab.added):
            return self.plain(t)
        return b"".join(array("I", [self.vocab.added[x]]).tobytes() if k % 2 else self.plain(x)
                        for k, x in enumerate(self.split(t)) if x)


class Speller:
    """The bytes of sequences of ids, gathered from one table."""

    def __init__(self, spelled: list[bytes | None]):
        self.size = np.array([-1 if s is None else len(s) for s in spelled], np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.size, 0))])[:-1]
        self.table = np.frombuffer(b"".join(s or b"" for s in spelled), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each id ends."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.table[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)], ends


_ENCODERS: dict[str, Encoder] = {}
_SPELLERS: dict[str, Speller] = {}


def encode(docs: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` and the token ids of ``text`` (array of int)."""
    path, name = tokenizer or default_tokenizer(), fresh(docs, ids)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        enc = _ENCODERS.get(path)
        if enc is None:
            enc = _ENCODERS[path] = Encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                raw = [enc(t) if t else b"" for t in batch.column(at).cast(pa.string()).to_pylist()]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                values = pa.array(np.frombuffer(b"".join(raw), np.uint32).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``coded`` and the text of its ``ids``; NULL ids give an empty text."""
    path, name = tokenizer or default_tokenizer(), fresh(coded, text)
    at = next(i for i, c in enumerate(coded.columns) if c.lower() == ids.lower())

    def run(batches):
        spell = _SPELLERS.get(path)
        if spell is None:
            spell = _SPELLERS[path] = Speller(Vocabulary(path).spelled)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                lists = batch.column(at)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat, ends = spell(lists.flatten().to_numpy(zero_copy_only=False))
                cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
                made = pa.BinaryArray.from_buffers(pa.binary(), len(n), [
                    None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                try:
                    made = made.cast(pa.string())
                except pa.ArrowInvalid:
                    made = pa.array([b.decode("utf-8", "replace") for b in made.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return coded.mapInArrow(run, T.StructType([*coded.schema, T.StructField(name, T.StringType())]))
