"""Operator 6, substring dedup: lookup of windows in an index of the whole corpus.

A window is ``window`` consecutive words.  A word goes if a window that
covers it starts earlier elsewhere.  The lookup of each window decides
that exactly and stands in place of a greedy relative Lempel-Ziv parse;
the index covers every document and lies in blocks, by window hash, over
the cluster.

1. Seeds: of the word ten-grams of a window the one with the least hash.
   Equal windows have equal seeds, so a window whose seed occurs once in
   the corpus is no copy.  Seeds change every few words, which makes
   this index about a sixth of one of all windows.
2. Windows with a repeated seed are looked up themselves, by a 96-bit
   hash, sorted with the least document first (those of very frequent
   seeds salted, in two steps); later places of the same document within
   the document.  This is exact at the ends of factors, where a window
   reaches over two factors, too.
3. Runs of found windows with one source document are the factors,
   without source positions (one need not be a copy of a single stretch);
   the words that they cover are the duplicate spans.

Texts equal to an earlier document's are left out of 1 and 2: all their
windows start earlier.  Repeated seeds reach the scan of step 2 as a
bitmap of ``sieve_bits`` bits, whatever their number; a full bitmap only
means that more windows are looked up.

Defined results: a NULL or empty text has no words; fewer words than a
window stay; NULL doc_ids come after all others; repeated rows (same
doc_id and text) get the same result each; different texts under one
doc_id don't remove each other's words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bag_minhash import mix, salt
from .common import sieve, stored, text_key

WINDOW = 20
SEED = 10
LAST = (1 << 63) - 1  # place of a NULL doc_id in the order
HOT = 1 << 16     # a seed with more than one in so many places is hot
SALTS = 64


@dataclass(frozen=True)
class Options:
    sieve_bits: int = 1 << 27


SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = 0xD1342543DE82EF95
#: Bytes that are hashed at once; a longer word is hashed in one piece.
SLICE = 1 << 20
_POWERS = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd factor modulo 2^64 and of its inverse."""
    global _POWERS
    if _POWERS.shape[1] < n:
        n = 1 << n.bit_length()
        f = np.array([[FACTOR], [pow(FACTOR, -1, 1 << 64)]], np.uint64)
        _POWERS = np.cumprod(np.hstack([np.ones((2, 1), np.uint64), np.repeat(f, n, axis=1)]), axis=1, dtype=np.uint64)
    return _POWERS


def hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words (polynomials over random byte values, freed of their place)."""
    b = np.frombuffer(data, np.uint8)
    solid = np.concatenate(([False], SOLID[b], [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[b] * up[:len(b)], dtype=np.uint64)))
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and where each text's words begin (and the end)."""
    out, firsts, count = [], [], 0
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < SLICE):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1 and size > SLICE:  # one long text: in slices that end at white space
            firsts.append([count])
            t, a = texts[at], 0
            while a < len(t):
                b = min(len(t), a + SLICE)
                while b < len(t) and SOLID[t[b]]:
                    b += 1
                h = hash_slice(t[a:b])[1]
                out.append(h)
                count, a = count + len(h), b
        else:
            starts, h = hash_slice(b"\n".join(texts[at:stop]))
            begin = np.cumsum([0, *(len(t) + 1 for t in texts[at:stop - 1])])
            firsts.append(count + np.searchsorted(starts, begin))
            out.append(h)
            count += len(h)
        at = stop
    return (np.concatenate(out) if out else np.zeros(0, np.uint64),
            np.concatenate([*firsts, [count]]).astype(np.int64))


def grams(h: np.ndarray, family: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 10 and of 20 words, by doubling; the family sets the hash function."""

    def join(a, b, step):
        return mix(a[:len(b)] + salt(family + step)) + b

    out = {}
    two = mix(join(h, h[1:], 1))
    four = mix(join(two, two[2:], 2))
    eight = mix(join(four, four[4:], 3))
    if family == 0:
        out[SEED] = mix(join(eight, two[8:], 4))
    sixteen = mix(join(eight, eight[8:], 5))
    out[WINDOW] = mix(join(sixteen, four[16:], 6))
    return out


def window_seeds(ten: np.ndarray) -> np.ndarray:
    """Least of each 11 neighbouring ten-gram hashes: the seed of each window."""
    two = np.minimum(ten[:-1], ten[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    return np.minimum(eight[:-3], eight[3:])


def windows(texts: list[bytes]):
    """Seed and hash of each window of the texts, the text it is in and its place there; and the word hashes."""
    h, first = word_hashes(texts)
    if len(h) < WINDOW:
        return None
    g = grams(h, 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    # windows that reach into the next text are left out
    whole = np.flatnonzero(owner[:len(h) - WINDOW + 1] == owner[WINDOW - 1:])
    return window_seeds(g[SEED])[whole], g[WINDOW][whole], owner[whole], whole, whole - first[owner[whole]], h


def seeds_of(texts: list[bytes]) -> np.ndarray:
    """The seeds of each text, once a text."""
    found = windows(texts)
    if found is None or not len(found[0]):
        return np.zeros(0, np.int64)
    seed, _, owner = found[:3]
    runs = np.concatenate(([True], (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])))
    seed, owner = seed[runs], owner[runs]
    order = np.lexsort((seed, owner))
    seed, owner = seed[order], owner[order]
    once = np.concatenate(([True], (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])))
    return seed[once].view(np.int64)


def window_rows(texts: list[bytes], bitmap: np.ndarray, hot: np.ndarray):
    """First places of the windows with a repeated seed.

    64 and 32 bits of hash, whether the seed is hot, text and position.
    """
    found = windows(texts)
    none = np.zeros(0, np.int64)
    if found is None or not len(found[0]):
        return none, none.astype(np.int32), none.astype(bool), none, none.astype(np.int32)
    seed, window, owner, place, pos, h = found
    bit = bits_of(seed, len(bitmap) * 64)
    near = np.flatnonzero((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
    order = near[np.lexsort((pos[near], window[near], owner[near]))]
    once = np.ones(len(order), bool)
    once[1:] = (window[order[1:]] != window[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    near = order[once]
    second = np.zeros(len(near), np.uint64)  # an independent hash of the same words
    for k in range(WINDOW):
        second = mix(second + h[place[near] + k] + salt(k + 7))
    is_hot = np.isin(seed[near], hot) if len(hot) else np.zeros(len(near), bool)
    return (window[near].view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32), is_hot,
            owner[near], pos[near].astype(np.int32))


def bits_of(seeds: np.ndarray, bits: int) -> np.ndarray:
    return mix(seeds + salt(99)) & np.uint64(bits - 1)


def cover(data: bytes, found: list[tuple[int, int]] | None, copy: bool):
    """Words, which of them go, and the factors (start, words, source document; None: the document itself)."""
    words = data.split()
    n = len(words)
    gone, factors = np.zeros(n, bool), []
    if n < WINDOW:
        return words, gone, factors
    if copy:
        gone[:] = True
        return words, gone, [(0, n, None)]
    source = np.full(n - WINDOW + 1, -1, np.int64)
    w = grams(word_hashes([data])[0], 0)[WINDOW]
    ordered = np.sort(w)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(w, kind="stable")
        source[order[1:][w[order[1:]] == w[order[:-1]]]] = -2
    if found is not None and len(found[0]):
        source[found[0]] = found[1]
    at = np.flatnonzero(source != -1)
    if len(at):
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(source[at]) != 0)) + 1
        for run in np.split(at, breaks):
            a, b = int(run[0]), int(run[-1]) + WINDOW
            gone[a:b] = True
            factors.append((a, b - a, None if source[a] == -2 else int(source[a])))
    return words, gone, factors


RESULT = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
          "factors array<struct<start:long,words:long,source:long>>")


def remove_repeats(docs: DataFrame, o: Options = Options(), with_text: bool = True) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, kept_text, factors."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       text_key().alias("h"))
    place = F.coalesce("doc_id", F.lit(LAST))
    keys = stored(base.where("text is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("doc", place), "sub-keys")
    first = keys.groupBy("h").agg(F.min("doc").alias("first"))
    copies = stored(keys.join(first, "h").where("doc > first").select("doc", F.col("h").alias("_h")), "sub-copies")
    shared = keys.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    # tells texts under one doc_id apart; zero, which takes no room, where there are none
    tag = (F.crc32("text") if shared else F.lit(0).cast("long")).alias("tag")

    marked = sieve(base.where("text is not null").withColumn("doc", place).withColumn("tag", tag), F.xxhash64("h"),
                   copies.select(F.xxhash64("_h").alias("k")), "_maybe")
    firsts = (marked.where("not _maybe").select("doc", "tag", "text")
              .union(marked.where("_maybe").join(copies.withColumnRenamed("doc", "_doc"),
                                                 F.expr("h = _h and doc = _doc"), "left_anti")
                     .select("doc", "tag", "text")))

    def in_parts(batch):
        """The texts of a batch in parts of a few MB: first row and texts."""
        part, size, first = [], 0, 0
        for k, t in enumerate(batch.column(2)):
            part.append(t.as_buffer().to_pybytes())
            size += len(part[-1])
            if size > 4 * SLICE:
                yield first, part
                part, size, first = [], 0, k + 1
        if part:
            yield first, part

    def seed_rows(batches):
        for batch in batches:
            for _, texts in in_parts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(seeds_of(texts))], names=["seed"])

    repeated = stored(firsts.mapInArrow(seed_rows, "seed long").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
                      .where("n > 1"), "sub-seeds")
    words = stored(repeated.select("seed").mapInArrow(lambda bs: bit_rows(bs, o.sieve_bits), "w long, m long")
                   .groupBy("w").agg(F.bit_or("m").alias("m")), "sub-bitmap")
    bitmap = np.zeros(o.sieve_bits // 64, np.uint64)
    got = words.toArrow()  # at most sieve_bits / 64 rows
    bitmap[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    # seeds with more than one place in HOT of all repeated ones: fewer than HOT
    places = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.sort(repeated.where(F.col("n") * HOT > places).where(f"n >= {SALTS}").select("seed").toArrow()
                  .column("seed").to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((bitmap, hot))

    def rows(batches):
        for batch in batches:
            docs_, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in in_parts(batch):
                w1, w2, is_hot, owner, pos = window_rows(texts, *sent.value)
                doc = docs_[first + owner]
                salted = np.where(is_hot, 1 + (mix(doc.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (w1, w2, salted.astype(np.int32), doc, tags[first + owner], pos)],
                    names=["w1", "w2", "salt", "doc", "tag", "pos"])

    # a window of a hot seed is dealt out to SALTS places by document, each with a least document of its own
    index = (firsts.mapInArrow(rows, "w1 long, w2 int, salt int, doc long, tag long, pos int")
             .repartition("w1", "w2", "salt").sortWithinPartitions("w1", "w2", "salt", "doc"))
    told = stored(index.mapInArrow(first_of_runs, "w1 long, w2 int, doc long, tag long, pos int, source long"), "sub-told")
    salted = told.where("w1 is not null")
    least = salted.groupBy("w1", "w2").agg(F.min("source").alias("least"))
    found = (told.where("w1 is null").select("doc", "tag", "pos", "source")
             .union(salted.join(least, ["w1", "w2"]).where("doc > least").select("doc", "tag", "pos", "least"))
             .groupBy("doc", "tag").agg(F.collect_list("pos").alias("pos"), F.collect_list("source").alias("sources")))
    found = stored(found, "sub-found")

    again = sieve(base.withColumn("doc", place).withColumn("tag", tag), F.xxhash64("doc"),
                  found.select(F.xxhash64("doc").alias("k")).union(copies.select(F.xxhash64("doc"))), "_maybe")
    none = F.lit(None).cast("array<int>").alias("pos"), F.lit(None).cast("array<long>").alias("sources")
    sure = again.where("not _maybe").select("doc_id", "text", F.lit(False).alias("copy"), *none)
    perhaps = (again.where("_maybe").join(copies.withColumn("copy", F.lit(True)).withColumnRenamed("doc", "_doc"),
                                          F.expr("doc = _doc and h = _h"), "left").drop("_doc", "_h")
               .join(found, ["doc", "tag"], "left")
               .select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "pos", "sources"))

    def finish(batches):
        for batch in batches:
            out = []
            for t, copy, pos, src in zip(*batch.columns[1:]):
                t = t.as_buffer()
                at = (pos.values.to_numpy(), src.values.to_numpy()) if pos.is_valid else None
                w, gone, factors = cover(t.to_pybytes() if t is not None else b"", at, copy.as_py())
                kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g]) if gone.any() else b" ".join(w)
                out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None,
                            [{"start": a, "words": b, "source": c} for a, b, c in factors]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))],
                names=[f.split()[0] for f in RESULT.split(", ")])

    return sure.union(perhaps).mapInArrow(finish, RESULT)


def first_of_runs(batches):
    """Rows in the order of window and document: those behind the window's first document, which becomes their source.

    Salted rows all go on, with the least document of their salt.  Only
    the last row is held from batch to batch, so a group may be of any size.
    """
    last, source = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, salted, doc, tag, pos = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (salted[1:] != salted[:-1])
        new[0] = last != (w1[0], w2[0], salted[0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(w1)), -1))
        first = np.where(at >= 0, doc[at], source)
        last, source = (w1[-1], w2[-1], salted[-1]), first[-1]
        out = np.flatnonzero((salted > 0) | (doc > first))
        plain = salted[out] == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(w1[out], mask=plain), pa.array(w2[out], mask=plain), pa.array(doc[out]), pa.array(tag[out]),
             pa.array(pos[out]), pa.array(first[out])], names=["w1", "w2", "doc", "tag", "pos", "source"])


def bit_rows(batches, bits: int):
    """Words of the bitmap that the seeds set."""
    for batch in batches:
        bit = bits_of(batch.column(0).to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array((bit >> np.uint64(6)).astype(np.int64)),
             pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["w", "m"])
