"""Operator 2, best-fit packing: best-fit decreasing over remaining capacities.

A document becomes its token ids plus an end id.  Longer documents are
cut into full pieces; the first piece takes the remainder.  Full pieces
are sequences of their own.  The others are packed by best-fit
decreasing over all documents at once: pieces in order of falling
length, each into the open sequence with the least room that still
holds it, found in a segment tree over remaining capacities.

Lengths are integers up to the capacity, so sequences with equal room
and pieces with equal length are interchangeable.  The plan is therefore
made on the histogram of lengths (at most ``capacity`` numbers, whatever
the size of the corpus) and says which ranks of a length go to which
run of sequences; rows find their place by a distributed rank.

Defined results: a NULL or empty text is one piece holding only the end
id; repeated rows are packed each on their own; ties go by doc_id, then
by ids; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a worker's word cache before it is emptied.
CACHE_WORDS = 1_000_000


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer file, and its vocabulary as a rank file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Stretches(dict):
    """Ids (little-endian 32-bit bytes) of a space and what follows it, up to the next space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, w: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[w] = array("I", self.encode(" " + w)).tobytes()
        return out


class Encoder:
    """Token ids of texts, with a cache of space-separated stretches.

    Byte-level BPE splits text before a space that precedes a non-space,
    so a text without other runs of white space is encoded stretch by
    stretch.  Texts with neighbouring white space, or with the string of
    a special token, are encoded whole by the tokenizer file itself.
    ``ranks`` may name the same vocabulary as a rank file, whose library
    encodes short strings faster; the vocabularies are compared first.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        encode = self.whole
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            vocab = self.tok.get_vocab(with_added_tokens=False)
            for w in self.special:
                vocab.pop(w, None)
            shown = printable_bytes()
            if {bytes(shown[c] for c in w): i for w, i in vocab.items()} != table:
                raise ValueError(f"{ranks} isn't the vocabulary of {path}")
            encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                       special_tokens={}).encode_ordinary
        self.encode, self.known = encode, Stretches(encode)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def __call__(self, t: str) -> bytes:
        if not simple(t) or any(s in t for s in self.special):
            return array("I", self.whole(t)).tobytes()
        first, *rest = t.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))


def printable_bytes() -> dict[str, int]:
    """The character that byte-level BPE files write for each byte: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space that may not stand beside a space: other ASCII ones by search, the rest by pattern.
BESIDE = [x for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f " for x in (f" {c}", f"{c} ")]
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def simple(t: str) -> bool:
    """True if each space stands between characters that are not white space."""
    return not (t[-1:] == " " or t[:1] == " " or any(x in t for x in BESIDE)
                or not t.isascii() and WIDE.search(t))


_ENCODERS: dict[tuple, Encoder] = {}


def tokenized(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, ranks: str | None) -> DataFrame:
    """One row per piece of every document."""

    def run(batches):
        enc = _ENCODERS.get((tokenizer, ranks))
        if enc is None:
            enc = _ENCODERS[tokenizer, ranks] = Encoder(tokenizer, ranks)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = enc(text.as_py() or "") + end
                n = len(raw) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    for c, v in zip(cols, (doc, piece, start, stop - start, zlib.crc32(raw[4 * start:4 * stop]))):
                        c.append(v)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


class RoomTree:
    """Segment tree over remaining capacities: the least one at or above a size that has open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, room: int, bins: int) -> None:
        i = room + self.size
        self.open[i] = int(bins > 0)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.size
        if self.open[i]:
            return size
        while i > 1:  # up to the first right neighbour with an open bin, then down its left edge
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths.

    Rows (length, first rank, pieces, first bin, pieces per bin, offset):
    of the pieces of that length, ranks from the first on fill bins from
    the first on, so many to a bin, starting at the offset.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first bin, bins)
    tree, bins, plan = RoomTree(capacity), 0, []

    def put(room, first, n):
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, 1)

    for size in sorted((s for s in counts if counts[s]), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:  # open the bins that the rest needs, as many to a bin as fit
                per = capacity // size
                n = -(-left // per)
                room = capacity
                rooms.setdefault(capacity, []).append((bins, n))
                tree.set(capacity, 1)
                bins += n
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                tree.set(room, 0)
            per = room // size
            full = min(n, left // per)
            if full:
                plan.append((size, rank, full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                put(room - per * size, first, full)
                first, n = first + full, n - full
            if left and n:  # fewer than fill a bin
                plan.append((size, rank, left, first, left, capacity - room))
                put(room - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    return plan


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None,
         ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    files = (tokenizer, ranks) if tokenizer else default_tokenizer()
    pieces = stored(tokenized(docs, capacity, end_id, *files), "pack-pieces")
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    table = np.array(plan, np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])
    with_rank = ranked(pieces, ["length"], ["doc_id", "ids_crc32", "piece"], "_rank", "pack-ranks")

    def place(batches):
        rows = sent.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            row = rows[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 4]),
                 pa.array(row[:, 5] + nth % row[:, 4] * length)],
                names=[*[f.split()[0] for f in PIECES.split(", ")], "sequence_id", "offset"])

    return (with_rank.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
            .mapInArrow(place, PIECES + ", sequence_id long, offset long"))
