"""Operator 9, benchmark decontamination: one Aho-Corasick automaton.

Every window of ten words of every benchmark item (a shorter item is one
window) becomes a pattern with a space at both ends.  A document's text
is normalised to lower-case words joined by single spaces and scanned
once; hits are mapped back to word positions and, through the word
starts, to byte offsets of the original text.

Defined results: NULL or wordless texts have no words and no hits; items
without words have no windows; rows repeated in either table count as
given (a repeated item id is one item); items with a NULL id are matched
under the id ``null``; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import from_arrow_schema

from .common import stored

WINDOW = 10
#: Patterns of one automaton; a larger benchmark is scanned in blocks of so many bytes.
BLOCK_BYTES = 4 << 20

#: A-Z to lower case; ASCII other than digits and letters to spaces; other bytes stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
SCANNED = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("hits", pa.list_(pa.int64())),
                     ("items", pa.list_(pa.string()))])
FINISHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                      ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words_of(data: bytes) -> list[bytes]:
    # NORMAL leaves 0x20 as the only white space
    return data.translate(NORMAL).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """Blocks of {window: item ids}, each of at most ``block_bytes`` of windows or one item."""
    block, size = {}, 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, text in rows.toLocalIterator(prefetchPartitions=True):
        own = windows_of(words_of(bytes(text or b"")), window)
        for w in own:
            size += 0 if w in block else len(w) + 64
            block.setdefault(w, set()).add("null" if item is None else item)
        if size >= block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def automaton(block: dict[bytes, set[str]]):
    # latin-1 maps bytes to characters one to one
    a = ahocorasick.Automaton()
    for w, items in block.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(items)))
    a.make_automaton()
    return a


_BUILT: dict = {}


def scan(docs: DataFrame, block: dict[bytes, set[str]], last: bool) -> DataFrame:
    """Adds the hits of one block (word ranges: start, end, start, end, ...), or finishes the rows."""
    sent, tag = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches):
        held = _BUILT.get(tag)
        if held is None:
            _BUILT.clear()
            _BUILT[tag] = held = automaton(sent.value)
        for batch in batches:
            out = []
            for t, old, old_items in zip(batch.column(1), batch.column(2), batch.column(3)):
                t = t.as_buffer()
                data = t.to_pybytes() if t is not None else b""
                words = words_of(data)
                own, found = old.as_py(), set(old_items.as_py())
                if words and len(held):
                    flat = " " + b" ".join(words).decode("latin-1") + " "
                    if at := list(held.iter(flat)):
                        # the word that ends at a space has as number the spaces before it
                        spaces = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
                        ends = np.searchsorted(spaces, np.array([e for e, _ in at]))
                        found.update(i for _, (_, ids) in at for i in ids)
                        own = merged([*zip(own[::2], own[1::2]),
                                      *((e - n, e) for e, (_, (n, _)) in zip(ends.tolist(), at))])
                items = sorted(found)
                if last:
                    ranges = list(zip(own[::2], own[1::2]))
                    n_hit = sum(b - a for a, b in ranges)
                    out.append((len(words), n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
                                n_hit > 0, [{"start": a, "end": b} for a, b in original_spans(data, ranges)]))
                else:
                    out.append((own, items))
            kept = 1 if last else 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *(pa.array([r[k] for r in out], f.type)
                                          for k, f in enumerate(list(schema)[kept:]))],
                schema=schema)

    schema = FINISHED if last else SCANNED
    return docs.mapInArrow(run, from_arrow_schema(schema))


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """The union of word ranges, flat and in order."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def original_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text for word ranges of the normalised text."""
    if not ranges:
        return []
    solid = np.frombuffer(data.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the byte ranges of the original text that hits cover.
    """
    state = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text",
                            "cast(array() as array<long>) hits", "cast(array() as array<string>) items")
    blocks = pattern_blocks(benchmark, window, block_bytes)
    block = next(blocks, {})
    while (following := next(blocks, None)) is not None:
        # each further block starts from a written table: one automaton is in memory at a time
        state = stored(scan(state, block, last=False), "decontaminate")
        block = following
    return scan(state, block, last=True)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, all columns as they were."""
    blocks = pattern_blocks(benchmark, window, block_bytes)
    block = next(blocks, {})
    while True:
        docs = docs.where(~has_hit(docs, block))
        following = next(blocks, None)
        if following is None:
            return docs
        docs, block = stored(docs, "decontaminate"), following


def has_hit(docs: DataFrame, block: dict[bytes, set[str]]):
    """A column: true where the text has a window of the block."""
    sent, tag = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        held = _BUILT.get(tag)
        if held is None:
            _BUILT.clear()
            _BUILT[tag] = held = automaton(sent.value)
        if not len(held):
            return pd.Series(np.zeros(len(texts), bool))
        flat = (b" ".join([b"", *words_of(bytes(t or b"")), b""]).decode("latin-1") for t in texts)
        return pd.Series([next(held.iter(x), None) is not None for x in flat], dtype=bool)

    return hit(F.col("text").cast("binary"))
