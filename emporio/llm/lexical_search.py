"""Operator 12, ranked lexical search: dense blocked matrix products with an exact top-k.

Every item is a query against every document.  The terms of a block of
items are its vocabulary; one scan of the documents keeps, of each, the
number of its terms and its counts of vocabulary terms.  Tiles of
documents become dense matrices of integer impacts, the block's items
dense matrices of integer weights, tile by tile of the vocabulary, and
their products in float64 are the scores.  A vocabulary tile ends before
the sum of an item's products could reach 2^53, so every product is an
exact integer; tiles are added as 64-bit integers.

Each task keeps the best ``k`` documents of every item over its tiles.
Equal scores go by doc_id in the tiles, in the task and in the end, so a
tie is never cut at random; the tasks' rows meet in one window by item.

Memory: a block has at most ``items`` items and ``terms`` (item, term)
rows, read back from a stored table and broadcast.  An item with more
terms is spread over several blocks, whose partial scores are added over
the documents before they are ranked.  Several blocks scan the documents
once each.

Defined results: NULL or empty texts and items have no terms; documents
without a common term aren't ranked; repeated items are ranked each on
their own and repeated documents take a rank each; a NULL doc_id comes
after all others of its score; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Impacts stay below this, whatever the counts.
MOST_IMPACT = 10 ** 6
#: Sum of an item's weights in a vocabulary tile, so that its products stay below 2^53.
MOST_WEIGHT = (1 << 53) // MOST_IMPACT - 1
#: Bytes of dense item matrices that a worker keeps; beyond, they are made anew for every tile of documents.
KEPT_BYTES = 64 << 20


@dataclass(frozen=True)
class Options:
    k: int = 10
    items: int = 512
    terms: int = 1 << 18
    tile_terms: int = 4096
    tile_docs: int = 512


#: Term bytes stay, with A-Z in lower case; the other ASCII bytes become blanks.
TERM_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32
                   for i in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def item_terms(numbered: DataFrame, o: Options) -> DataFrame:
    """Rows (block, item, spread, term, qtf); an item's rows are in one block unless there are too many."""

    def run(batches):
        block, items, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = sorted(Counter(terms_of(text)).items())
                spread = len(counts) > o.terms
                if counts and held and (spread or items >= o.items or held + len(counts) > o.terms):
                    block, items, held = block + 1, 0, 0
                for at in range(0, len(counts), o.terms):
                    if at:
                        block += 1
                    part = counts[at:at + o.terms]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block] * len(part), pa.int64()), "item": pa.array([item] * len(part), pa.int64()),
                        "spread": pa.array([spread] * len(part)), "term": pa.array([t.decode() for t, _ in part]),
                        "qtf": pa.array([n for _, n in part], pa.int64())})
                if counts:
                    items, held = items + 1, o.terms if spread else held + len(counts)

    return numbered.mapInArrow(run, "block long, item long, spread boolean, term string, qtf long")


def counted(docs: DataFrame, column: dict[bytes, int]) -> DataFrame:
    """key, doc_id, n, cols, tfs of every document with a term: its counts of the vocabulary's terms by column."""
    sent = docs.sparkSession.sparkContext.broadcast(column)

    def run(batches):
        get, width = sent.value.get, len(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, hits, sizes = [], [], []
                for text in batch.column(2).to_pylist():
                    ws = terms_of(text)
                    own = [c for c in map(get, ws) if c is not None]
                    n.append(len(ws))
                    sizes.append(len(own))
                    hits += own
                key = np.repeat(np.arange(len(n)), sizes) * width + np.array(hits, np.int64)
                key, tf = np.unique(key, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["key", "doc_id", "n", "cols", "tfs"])

    return docs.mapInArrow(run, "key long, doc_id long, n long, cols array<int>, tfs array<long>").where("n > 0")


def weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2df + 1)))"""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vocabulary_tiles(item: np.ndarray, col: np.ndarray, weights: list[int], n_items: int, tile_terms: int):
    """Tiles (columns, [(row, place in the tile, weight)]) in which no item's weights exceed ``MOST_WEIGHT``.

    A larger weight is cut, and its column stands in several tiles.
    """
    by_col: dict[int, list[tuple[int, int]]] = {}
    for i, c, w in zip(item.tolist(), col.tolist(), weights):
        if w > 0:
            by_col.setdefault(c, []).append((i, w))
    tiles, cols, rows, used = [], [], [], [0] * n_items
    for c in sorted(by_col):
        left = by_col[c]
        while left:
            part = [(i, min(w, MOST_WEIGHT)) for i, w in left]
            left = [(i, w - MOST_WEIGHT) for i, w in left if w > MOST_WEIGHT]
            if cols and (len(cols) >= tile_terms or any(used[i] + w > MOST_WEIGHT for i, w in part)):
                tiles.append((cols, rows))
                cols, rows, used = [], [], [0] * n_items
            for i, w in part:
                used[i] += w
                rows.append((i, len(cols), w))
            cols.append(c)
    if cols:
        tiles.append((cols, rows))
    return [(np.array(c), np.array(r, np.int64).reshape(-1, 3)) for c, r in tiles]


class Scorer:
    """Scores of tiles of documents against one block of items."""

    def __init__(self, tiles, n_items: int, n_docs: int, n_terms: int):
        self.tiles, self.n_items, self.n_docs, self.n_terms = tiles, n_items, n_docs, n_terms
        self.keep = sum(len(c) for c, _ in tiles) * n_items * 8 <= KEPT_BYTES
        self.dense: dict[int, np.ndarray] = {}

    def items(self, k: int) -> np.ndarray:
        out = self.dense.get(k)
        if out is None:
            cols, rows = self.tiles[k]
            out = np.zeros((self.n_items, len(cols)))
            out[rows[:, 0], rows[:, 1]] = rows[:, 2]
            if self.keep:
                self.dense[k] = out
        return out

    def __call__(self, n: np.ndarray, doc: np.ndarray, col: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Items x documents as int64; ``doc``, ``col``, ``tf`` are the tile's counts."""
        # Python numbers: the product of the three may exceed 64 bits
        m = np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        impact = 10 ** 9 * tf // (1000 * tf + 8 * m[doc])
        total = np.zeros((self.n_items, len(n)), np.int64)
        for k, (cols, _) in enumerate(self.tiles):
            at = np.searchsorted(cols, col)
            own = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == col)
            docs = np.zeros((len(cols), len(n)))
            docs[at[own], doc[own]] = impact[own]
            total += np.rint(self.items(k) @ docs).astype(np.int64)
        return total


def first_k(item, score, null, doc, k: int):
    """The first ``k`` rows of each item: highest score, then least doc_id, NULL last."""
    order = np.lexsort((doc, null, -score, item))
    item, score, null, doc = (x[order] for x in (item, score, null, doc))
    first = np.searchsorted(item, item)
    keep = np.arange(len(item)) - first < k
    return item[keep], score[keep], null[keep], doc[keep]


def scores(postings: DataFrame, scorer: Scorer, numbers: np.ndarray, whole: np.ndarray, o: Options) -> DataFrame:
    """Rows (item, key, doc_id, score): the best of each task, and of items not in ``whole`` every score above 0.

    ``numbers`` are the items of the scorer's rows; ``key`` is NULL but for items not in ``whole``.
    """
    sent = postings.sparkSession.sparkContext.broadcast((scorer, numbers, whole))
    names = ["item", "key", "doc_id", "score"]

    def run(batches):
        score_of, numbers, whole = sent.value
        kept = tuple(np.empty(0, np.int64) for _ in range(4))
        least = np.zeros(score_of.n_items, np.int64)   # a lower score can't be among the first k any more

        def rows(item, score, null, doc, key):
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers[item], pa.int64()), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(item), pa.int64()),
                 pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, o.tile_docs):
                tile = batch.slice(at, o.tile_docs)
                key = tile.column(0).to_numpy()
                null = tile.column(1).is_null().to_numpy(zero_copy_only=False)
                ids = tile.column(1).fill_null(0).to_numpy()
                size = tile.column(3).value_lengths().to_numpy()
                got = score_of(tile.column(2).to_numpy(), np.repeat(np.arange(len(ids)), size),
                               tile.column(3).flatten().to_numpy(), tile.column(4).flatten().to_numpy())
                if not whole.all():
                    i, d = np.nonzero((got > 0) & ~whole[:, None])
                    yield rows(i, got[i, d], null[d], ids[d], key[d])
                i, d = np.nonzero((got > 0) & (got >= least[:, None]) & whole[:, None])
                kept = first_k(*(np.concatenate(x) for x in zip(kept, (i, got[i, d], null[d].astype(np.int64), ids[d]))), o.k)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(least)) >= o.k)
                least[full] = kept[1][np.searchsorted(kept[0], full, "right") - 1]
        if len(kept[0]):
            yield rows(*kept, None)

    return (postings.select("key", "doc_id", "n", "cols", "tfs")
            .mapInArrow(run, "item long, key long, doc_id long, score long"))


def search(docs: DataFrame, items: DataFrame, o: Options = Options()) -> DataFrame:
    """The best ``k`` documents of every item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id",
                                   F.col("text").cast("string").alias("text")), "search-items")
    rows = stored(item_terms(numbered.select("item", "text"), o), "search-terms")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    if not rows.where("spread").isEmpty():
        docs = stored(docs, "search-documents")  # an item's partial scores meet by a fixed key
    found = spark.createDataFrame([], "item long, key long, doc_id long, score long")
    # one number a block; the rows of one block at a time reach the driver, never documents
    for (block,) in sorted(map(tuple, rows.select("block").distinct().collect())):
        own = rows.where(F.col("block") == block).toPandas()
        column = {t: c for c, t in enumerate(sorted(set(own["term"])))}
        postings = stored(counted(docs, {t.encode(): c for t, c in column.items()}), "search-counts")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = {r["col"]: r["n"] for r in postings.select(F.explode("cols").alias("col")).groupBy("col")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
        numbers = np.unique(own["item"])
        col = own["term"].map(column).to_numpy()
        weights = [weight(n_docs, df[c]) * q if c in df else 0 for c, q in zip(col.tolist(), own["qtf"].tolist())]
        tiles = vocabulary_tiles(np.searchsorted(numbers, own["item"]), col, weights, len(numbers), o.tile_terms)
        whole = ~np.isin(numbers, own.loc[own["spread"], "item"])
        scorer = Scorer(tiles, len(numbers), n_docs, int(n_terms))
        found = found.union(stored(scores(postings, scorer, numbers, whole, o), "search-scores"))
    parts = (found.where("key is not null").groupBy("item", "key", "doc_id").agg(F.sum("score").alias("score"))
             .select("item", "doc_id", "score"))
    found = found.where("key is null").select("item", "doc_id", "score").union(parts)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
