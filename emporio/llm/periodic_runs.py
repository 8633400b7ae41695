"""Operator 13, periodic run detection: maximal pairs from an LCP-interval tree.

A run is a stretch of words with smallest period q, at least two periods
and ``least`` words long, that no neighbouring word extends.  Two places
p < p + d that share their next l words, but neither the word before nor
the one after (a maximal pair), span the stretch of l + d words from p
with period d.  If d <= l it is a run, or one with a multiple of its
smallest period; so the maximal pairs with d <= l and l + d >= ``least``,
the least d for each stretch, are exactly the runs and need no extension.

Pairs come from the suffix array of the words.  Its LCP intervals are
closed bottom-up, and each holds its places twice: in order, and in lists
by the word to their left.  Where two children of an interval of depth l
meet, their places differ in the next word; a place of the smaller child
is held against those of the larger at distance up to l whose left word
is another one.  That is a walk in order, or by the class lists if the
window holds more places than there are classes.  As 2l >= l + d, only
intervals of at least ``least`` / 2 words matter.

Suffixes of many texts are sorted at once, by doubling in numpy.  Texts
in which no stretch of ``least`` / 2 words comes twice (by hash, so that
none is missed) are left out before.  Memory: ``CHUNK`` words, or those
of one text if it has more, with a number a word and doubling.

Defined results: a NULL text has no runs and stays NULL; an empty one has
none; words are what stands between ASCII white space; every row is
judged on its own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

#: Words of texts whose suffixes are sorted together.
CHUNK = 1 << 19
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal for equal words, and where each text begins."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for ws in texts for w in ws]
    return np.array(flat, np.int64), np.cumsum([0, *map(len, texts)])


def repeating(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some ``width`` consecutive words come twice, and perhaps others."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(len(first) - 1, bool)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, np.uint64)
        for j in range(width):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[j:j + n]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = text[:n] == text[width - 1:]
        key, text = key[inside], text[:n][inside]
        key = key ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(key)
    key, text = key[order], text[order]
    twice = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][twice], minlength=len(first) - 1) > 0


def suffixes(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places in suffix order, the ranks of their next 1, 2, 4, ... words, and the left words.

    Every text ends with a number of its own and shares no number with
    another text, so that no two places share words across an end.
    """
    n_texts, width = len(first) - 1, int(ids.max(initial=-1)) + 2
    size = np.diff(first)
    text = np.repeat(np.arange(n_texts), size + 1)
    at = np.arange(len(ids)) + np.repeat(np.arange(n_texts), size)
    word = np.full(len(text), width - 1, np.int64)
    word[at] = ids
    word += text * width
    left = np.concatenate([[-1], word[:-1]])   # at a text's begin, the end of the one before, which no other place has
    sa = np.argsort(word, kind="stable")
    sorted_ = word[sa]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(len(word), np.int64)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, k = [rank], 1
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))   # in groups of several places
        if not len(open_):
            return sa, levels, left
        places = sa[open_]
        ahead = np.where(places + k < len(rank), rank[np.minimum(places + k, len(rank) - 1)], -1)
        order = np.lexsort((ahead, rank[places]))
        places, ahead = places[order], ahead[order]
        old = rank[places]
        sa[open_] = places
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])])
        head[open_] = new
        rank = rank.copy()
        rank[places] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        levels.append(rank)
        k *= 2


def shared(sa: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Words shared by neighbours in suffix order; 0 where it is under ``least``."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    k = least.bit_length() - 1
    close = np.flatnonzero(levels[k][a] == levels[k][b]) if k < len(levels) else np.empty(0, np.int64)
    a, b = a[close], b[close]
    length = np.zeros(len(close), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        rank = levels[step]
        length += np.where(rank[a + length] == rank[b + length], 1 << step, 0)
    out = np.zeros(len(sa), np.int64)
    out[close + 1] = np.where(length >= least, length, 0)
    return out


class Places:
    """Places of an interval, in order and in lists by their left word."""

    __slots__ = ("order", "classes")

    def __init__(self, p: int, left: int):
        self.order, self.classes = [p], {left: [p]}

    def meet(self, p: int, own: int, depth: int, left: list[int]):
        """Places at distance up to ``depth`` from ``p`` with another left word."""
        order = self.order
        i, j = bisect_left(order, p - depth), bisect_right(order, p + depth)
        if j - i <= len(self.classes):
            for q in order[i:j]:
                if left[q] != own:
                    yield q
        else:
            for c, places in self.classes.items():
                if c != own:
                    yield from places[bisect_left(places, p - depth):bisect_right(places, p + depth)]

    def add(self, p: int, own: int) -> None:
        insort(self.order, p)
        insort(self.classes.setdefault(own, []), p)


def joined(a: Places, b: Places, depth: int, least: int, left: list[int], found: dict) -> Places:
    """Two children of an interval of ``depth`` words become one; their maximal pairs go to ``found``."""
    if len(a.order) < len(b.order):
        a, b = b, a
    for p in b.order:
        for q in a.meet(p, left[p], depth, left):
            d = abs(p - q)
            if depth + d >= least:
                stretch = (min(p, q), depth + d)
                found[stretch] = min(d, found.get(stretch, d))
    for p in b.order:
        a.add(p, left[p])
    return a


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int], least: int) -> dict[tuple[int, int], int]:
    """(start, length) -> least period, from the intervals over neighbours that share words."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Places]] = []   # open intervals: depth, places of the children so far
    last = None
    for p, depth in zip(sa, lcp):
        while stack and stack[-1][0] > depth:
            d, held = stack.pop()
            last = joined(held, last, d, least, left, found)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1] = depth, joined(stack[-1][1], last, depth, least, left, found)
            else:
                stack.append((depth, last))
        last = Places(p, left[p])
    while stack:
        d, held = stack.pop()
        last = joined(held, last, d, least, left, found)
    return found


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    half = -(-least // 2)
    ids, first = numbered(texts)
    maybe = np.flatnonzero(repeating(ids, first, half))
    if not len(maybe):
        return out
    size = np.diff(first)[maybe]
    ids = np.concatenate([ids[first[k]:first[k + 1]] for k in maybe])
    first = np.concatenate([[0], np.cumsum(size)])
    sa, levels, left = suffixes(ids, first)
    lcp = shared(sa, levels, half)
    near = np.flatnonzero((lcp > 0) | np.append(lcp[1:] > 0, False))
    pairs = maximal_pairs(sa[near].tolist(), lcp[near].tolist(), left.tolist(), least)
    starts = first[:-1] + np.arange(len(maybe))   # in the numbering with an end behind each text
    stretches = sorted((start, d, length) for (start, length), d in pairs.items())
    owner = np.searchsorted(starts, [s for s, _, _ in stretches], "right") - 1
    for (start, d, length), k in zip(stretches, owner.tolist()):
        out[maybe[k]].append((start - int(starts[k]), length, d))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run holds after its first period, joined by a blank."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(drop).tolist()) if not n]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame, least: int = 12, runs: str = "runs", text: str = "collapsed") -> DataFrame:
    """The rows of ``docs`` with all runs of ``text`` and the text without their repetitions."""
    if least < 2:
        raise ValueError("a run has two words at least")
    names = [fresh(docs, runs), fresh(docs, text)]
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUNS.elementType.fields]))

    def made(batch: pa.RecordBatch, words: list[list[bytes] | None]) -> pa.RecordBatch:
        found = runs_of([ws or [] for ws in words], least)
        flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        values = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], [f.name for f in kind.value_type])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(ends, values),
             pa.array([None if ws is None else collapsed(ws, own) for ws, own in zip(words, found)], pa.string())],
            names=[*batch.schema.names, *names])

    def run(batches):
        for batch in batches:
            words, n, done = [], 0, 0
            for t in batch.column(at).cast(pa.string()):
                own = None if not t.is_valid else t.as_py().encode().split()
                words.append(own)
                n += len(own or ())
                if n >= CHUNK:
                    yield made(batch.slice(done, len(words)), words)
                    done, words, n = done + len(words), [], 0
            if words:
                yield made(batch.slice(done, len(words)), words)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(names[0], RUNS), T.StructField(names[1], T.StringType())]))
