"""Operator 8, quality rules: compression bands.

zstandard ratios (raw bytes / compressed bytes) of the whole text and of
fixed chunks, held against limits that depend on the length.  A high
ratio is a repetitive text, a ratio near 1 an incompressible one.

Defined results: NULL and empty texts have zero words and fail the base
rule; repeated rows get one row each; a tie with a limit passes; an
empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, ratio double, "
          "n_chunks long, n_bad_chunks long")

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits by length: (from this many bytes, least ratio, greatest ratio).

    Short texts carry the frame's overhead and have little to refer back
    to, so their band starts lower and ends lower; long texts find more
    to refer to.  Chunks of ``chunk`` bytes are judged by the band of
    their own length; a text fails if more than ``bad_share`` of its
    chunks do.
    """
    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0), (128, 1.0, 3.0), (256, 1.15, 3.5), (1024, 1.45, 4.0), (4096, 1.60, 4.5), (32768, 1.60, 6.0))
    chunk: int = 4096
    bad_share: float = 0.5
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        low, high = self.limits[0][1:]
        for start, a, b in self.limits:
            if n >= start:
                low, high = a, b
        return low, high


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(set(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) < 1 << 21:
        key = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    else:  # number the pairs first, so that three ids fit one integer
        _, pair = np.unique((a[:-1] << 31) | a[1:], return_inverse=True)
        key = (pair[:-1].astype(np.int64) << 31) | a[2:]
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    rep = np.zeros(n - 2, bool)
    rep[order[1:][same]] = True
    rep[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= rep
    return int(hit.sum())


def verdict(data: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    def ratio(x):
        return len(x) / len(z.compress(x)) if x else 1.0

    def inside(x, r):
        low, high = bands.of(len(x))
        return low <= r <= high

    whole = ratio(data)
    chunks = [data[i:i + bands.chunk] for i in range(0, len(data), bands.chunk)]
    if len(chunks) > 1:
        bad = sum(not inside(c, ratio(c)) for c in chunks)
    else:
        bad = int(not inside(data, whole)) if chunks else 0
    return inside(data, whole) and bad <= bands.bad_share * len(chunks), whole, len(chunks), bad


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: word and symbol counts, base rule, compression verdict."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            cols = [[] for _ in range(10)]
            for t in batch.column(1):
                t = t.as_buffer()
                data = t.to_pybytes() if t is not None else b""
                words = data.split()
                n = len(words)
                lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
                rep = repeat_words(words)
                failed = n < 50 or 100 * rep > 50 * n
                ok, whole, chunks, bad = verdict(data, bands, z)
                row = (n, len(data.translate(None, WHITE + CONTINUATION)),
                       len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), rep,
                       failed, not failed and ok, whole, chunks, bad)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2
                                                                    + [pa.float64()] + [pa.int64()] * 2))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return picked.mapInArrow(run, SCHEMA)
