"""Operator 7, near-duplicates: BagMinHash over multisets of five-word shingles.

A shingle that occurs w times has weight w, discretised at the integers.
The weight axis is cut into (0, 1], (1, 2], (2, 4], (4, 8], ...; each
shingle has one Poisson process on each stretch, its rate the stretch's
length, and every point has a time, a register and a level.  A document
takes the points whose level its weight reaches; a register holds its
earliest time.  Two documents agree in a register with a probability
equal to their weighted Jaccard similarity, and points after the last
register is filled are never drawn.

Registers are banded; documents that meet in a band are compared by
exact multiset overlap, sum of least weights by sum of greatest.
Pairs are made in small buckets only; large ones are compared with one
member first, and what is left in different classes block against block
in matrix products (``common.bucket_classes``), so that no link inside a
bucket is lost.

Defined results: words are split at ASCII white space, ASCII letters in
lower case; a text of one to four words is one shingle; a text without
words, or NULL, is a class of its own; equal texts are one class; a
class takes its least doc_id as name (NULL if it has no other); repeated
rows belong to one class and one of them is kept; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_classes, fresh, sieve, stored, text_key

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def salt(k: int) -> np.uint64:
    """The k-th multiple of the golden ratio, modulo 2^64."""
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Options:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5      # registers of a band: 0.9999 of the pairs at 0.8 share one
    elements: int = 400_000  # shingles that are drawn for at once

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        out = self[w] = xxhash.xxh3_64_intdigest(w)
        return out


_HASHES = WordHashes()


def bag(data: bytes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out + GOLDEN) + h[i:i + n]
    return np.unique(mix(out), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """``m`` registers (times) for each non-empty bag."""
    out = np.full((len(bags), m), np.inf)
    total = np.array([w.sum() for _, w in bags], np.float64)
    # the register that is filled last takes about ln m means; a bag left short is drawn again, for longer
    horizon = m * (np.log(m) + 2.0) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        e = np.concatenate([bags[i][0] for i in todo])
        w = np.concatenate([bags[i][1] for i in todo])
        d = np.repeat(todo, [len(bags[i][0]) for i in todo])
        low, high = np.zeros(len(e), np.int64), np.ones(len(e), np.int64)
        parts, step = [(e, w, d, low, high)], 1
        while True:  # the stretches (1, 2], (2, 4], ... that the weight reaches into
            more = w > step
            if not more.any():
                break
            e, w, d = e[more], w[more], d[more]
            parts.append((mix(e + salt(step)), w, d, np.full(len(e), step), np.full(len(e), 2 * step)))
            step = step * 2
        e, w, d, low, high = (np.concatenate(x) for x in zip(*parts))
        t, k = np.zeros(len(e)), 0
        flat = out.reshape(-1)
        while len(e):
            base = 3 * k + 1
            t = t - np.log(unit(mix(e + salt(base)))) / (high - low)
            on = t < horizon[d]
            e, w, d, low, high, t = e[on], w[on], d[on], low[on], high[on], t[on]
            register = (mix(e + salt(base + 1)) >> np.uint64(32)).astype(np.int64) % m
            wide = high - low > 1
            if wide.any():
                level = low + 1 + np.floor(unit(mix(e + salt(base + 2))) * (high - low)).astype(np.int64)
                take = level <= w
                np.minimum.at(flat, d[take] * m + register[take], t[take])
            else:
                np.minimum.at(flat, d * m + register, t)
            k += 1
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        horizon[todo] *= 2
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    key = np.tile(np.array([salt(b) for b in range(bands)]), (len(sig), 1))
    for r in range(bits.shape[2]):
        key = mix(key + GOLDEN + bits[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, o: Options) -> DataFrame:
    """One row per document: doc_id, key of its text, number of words' shingles, band keys."""

    def run(batches):
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                bags, size, stop = [], 0, at
                while stop < n and size < o.elements:
                    t = batch.column(2)[stop].as_buffer()
                    bags.append(bag(t.to_pybytes() if t is not None else None, o.words))
                    size += len(bags[-1][0])
                    stop += 1
                full = [i for i, (e, _) in enumerate(bags) if len(e)]
                keys = band_keys(signatures([bags[i] for i in full], o.registers), o.bands).reshape(-1)
                ends = np.zeros(len(bags) + 1, np.int32)
                ends[np.array(full, int) + 1] = o.bands
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(keys, pa.int64()))],
                    names=["doc_id", "h", "bands"])
                at = stop

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"),
                        F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, h binary, bands array<long>"))


def overlap(a, b) -> float:
    """Weighted Jaccard similarity of two bags."""
    (ea, wa), (eb, wb) = a, b
    _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(wa[i], wb[j]).sum())
    return shared / max(1, int(wa.sum() + wb.sum()) - shared)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The text of each node in ``wanted(node)``."""
    need = stored(wanted.join(nodes, "node").select("node", F.col("first_id").alias("_first"), F.col("h").alias("_h")),
                  f"{name}-need")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                        text_key().alias("h"))
    texts = (sieve(keyed, F.xxhash64("h"), need.select(F.xxhash64("_h").alias("k")), "_maybe").where("_maybe")
             .join(need, F.expr("h = _h and doc_id <=> _first")).select("node", "text"))
    return stored(texts.dropDuplicates(["node"]), f"{name}-texts")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, o: Options, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough, by exact overlap."""
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(),
                     nodes, docs, name)
    both = (pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
            .join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb"))

    def run(batches):
        held: dict[int, tuple] = {}

        def of(node, text):
            if node not in held:
                if len(held) >= 256:
                    held.clear()
                held[node] = bag(text.as_buffer().to_pybytes(), o.words)
            return held[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = [overlap(of(x, t), of(y, u)) >= o.similarity
                  for x, y, t, u in zip(a, b, batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return stored(both.mapInArrow(run, "a long, b long"), f"{name}-links")


def compared(near: DataFrame, nodes: DataFrame, docs: DataFrame, o: Options, name: str) -> DataFrame:
    """Pairs of classes with similar texts, block against block of each cluster."""
    texts = texts_of(near.select("node"), nodes, docs, f"{name}-block")
    # a node goes to every pair of blocks that its own is part of
    to = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    dealt = near.join(texts, "node").select("cluster", F.explode(to).alias("p"), "node", "root", "block", "text")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        roots, block = frame["root"].to_numpy(), frame["block"].to_numpy()
        ok = similar([bag(bytes(t), o.words) for t in frame["text"]], o.similarity)
        ok &= roots[:, None] != roots[None, :]
        if i != j:
            ok &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(ok, 1))
        found = np.unique(np.sort(np.column_stack([roots[a], roots[b]]), axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return (dealt.select("cluster", "p.i", "p.j", "root", "block", "text").groupBy("cluster", "i", "j")
            .applyInPandas(run, "a long, b long"))


def similar(bags: list[tuple[np.ndarray, np.ndarray]], least: float, width: int = 4096) -> np.ndarray:
    """Which pairs of bags are similar enough: shared weight by products of 0/1 matrices.

    The c-th copy of a shingle is a column, so that a product counts the least weights.
    """
    row = np.repeat(np.arange(len(bags)), [int(w.sum()) for _, w in bags])
    shingle = np.concatenate([np.repeat(e, w) for e, w in bags])
    copy = np.concatenate([np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) for _, w in bags])
    _, col, n = np.unique(mix(shingle + mix(copy.astype(np.uint64) + GOLDEN)), return_inverse=True, return_counts=True)
    shared_cols = np.flatnonzero(n > 1)
    place = np.full(len(n), -1, np.int64)
    place[shared_cols] = np.arange(len(shared_cols))
    at = place[col]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(bags), len(bags)), np.float32)
    for start in range(0, len(shared_cols), width):
        a, b = np.searchsorted(at, [start, start + width])
        x = np.zeros((len(bags), width), np.float32)
        x[row[a:b], at[a:b] - start] = 1
        shared += x @ x.T
    total = np.array([w.sum() for _, w in bags], np.float64)
    return shared >= least * (total[:, None] + total[None, :] - shared)


def classes(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per document: doc_id, h (key of its text), class_id, class_size, keep, copies.

    ``copies`` counts the rows with this doc_id and text.
    """
    sig = stored(signed(docs, o), "bag-signatures")
    nodes = stored(sig.where("size(bands) > 0").groupBy("h").agg(F.min("doc_id").alias("first_id"))
                   .withColumn("node", F.monotonically_increasing_id()), "bag-nodes")
    banded = (sig.alias("s").join(nodes.alias("n"), F.expr("s.h = n.h and s.doc_id <=> n.first_id"))
              .select("node", F.explode("bands").alias("key")))
    labels = bucket_classes(banded.distinct(), lambda pairs, name: verified(pairs, nodes, docs, o, name),
                            lambda near, name: compared(near, nodes, docs, o, name), "bag")

    named = nodes.join(labels, "node", "left").select("h", "first_id", F.coalesce("root", "node").alias("root"))
    of_class = named.groupBy("root").agg(F.min("first_id").alias("class_id"),
                                         F.min(F.struct(F.col("first_id").isNull().alias("z"), "first_id", "h"))["h"]
                                         .alias("first_h"))
    per_text = named.join(of_class, "root").select("h", "root", "class_id", (F.col("h") == F.col("first_h")).alias("head"))
    rows = sig.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("copies"), F.max(F.size("bands") > 0).alias("has"))
    joined = rows.join(per_text, "h", "left")
    sizes = joined.where("has").groupBy("root").agg(F.sum("copies").alias("class_size"))
    return (joined.join(sizes, "root", "left")
            .select("doc_id", "h", F.when(F.col("has"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(F.col("has"), F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
                    F.when(F.col("has"), F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id")))
                    .otherwise(True).alias("keep"), "has", "copies"))


def near_duplicates(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, keep (one row of each class)."""
    c = stored(classes(docs, o), "bag-result")
    # repeated rows: the first of them is kept
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (c.select("doc_id", "class_id", "class_size", "keep", "has", nth.alias("_nth"))
            .select("doc_id", "class_id", "class_size",
                    (F.col("keep") & (~F.col("has") | (F.col("_nth") == 1))).alias("keep")))


def keep_one(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """The documents with one row of each class, all columns as they were."""
    c = stored(classes(docs, o), "bag-result")
    acts = c.where("not keep or (has and copies > 1)").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "keep")
    key, maybe = fresh(docs, "_text_key"), fresh(docs, "_maybe")
    flagged = sieve(docs.withColumn(key, text_key()), F.xxhash64(key), acts.select(F.xxhash64("_h").alias("k")), maybe)
    sure = flagged.where(~F.col(maybe)).select(*docs.columns)
    act, d = fresh(docs, "_keep"), fresh(docs, "_d")
    acts = acts.select(F.col("_d").alias(d), F.col("_h").alias(d + "h"), F.col("keep").alias(act))
    open_ = (flagged.where(F.col(maybe))
             .join(acts, F.col(key).eqNullSafe(F.col(d + "h")) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)), "left"))
    return (sure.union(open_.where(F.col(act).isNull()).select(*docs.columns))
            .union(open_.where(F.col(act)).dropDuplicates([d, d + "h"]).select(*docs.columns)))
