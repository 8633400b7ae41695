"""Operator 4, line dedup: fuzzy lines by MinHash.

A line, in lower case, its stretches of white space as one blank and none
at its ends, is the set of its character shingles: ``width`` characters
from every position, and a shorter line is one shingle.

Signatures have ``bands * rows`` minima.  For a large set a shingle's hash
falls into one of so many bins and a bin's minimum is a row; the shingles
of a batch are sorted once, and bins, minima and the exact size of each
set are read off.  A set of up to ``small`` shingles leaves bins empty and
gets minima under independent permutations.  From ``similarity * small``
shingles on a set has both kinds, so that two sets which are similar
enough always have a kind in common.

Lines that share a band's key are candidates, unless their sizes or their
sketches (two bits of each minimum) rule the similarity out: random lines
of a language share keys too, in numbers that grow with the square of the
input.  A similar pair is lost so with a probability of 1e-9 at most.
Candidates with an exact Jaccard similarity of ``similarity`` are linked, linked lines form components (distributed
union-find), and of all places of a component's lines the first stays.

Equal lines are one line from the start.  The lines of a bucket are
compared with one of them first.  Other pairs are made in small buckets
only, of lines that aren't in one class by then; a large bucket that
isn't one class is compared block against block, by sketches and then by
text, without emitting pairs.
Signatures and exact checks run in Arrow batches (the README says why);
joins, grouping, union-find and the assembly of texts are SQL functions.

Defined results: a NULL text stays NULL; lines without a word are never
removed; the first place is the one with the least doc_id (NULL last),
then the least text hash, then the first line; repeated rows (same
doc_id and text) are one place; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, SMALL_BUCKET, components, fresh, sieve, stored


@dataclass(frozen=True)
class Options:
    similarity: float = 0.8
    bands: int = 18
    rows: int = 5    # minima of a band: 0.9992 of the pairs at 0.8 share one
    width: int = 5
    small: int = 250


#: Characters of the lines whose shingles are sorted together; the arrays stay in a core's cache.
CHUNK_CHARS = 1 << 16
#: A line at more than 1 / HOT of all places is joined by a broadcast; there are HOT of them at most.
HOT = 1024
#: Odd factors of the hashes (own choice).
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Bits of a hash that are kept beside the number of its line.
HASH_BITS = np.uint64(44)
EMPTY = np.uint64(0)
#: Minima in a word of a sketch, two bits each; the lower bit of each.
IN_WORD, LOW = 30, 0x1555555555555555
#: Probability at most that the sketches of a pair that is just similar rule it out.
LOST = 1e-9
#: Nodes of a block, and of a strip of one, in the comparison of large buckets by sketches.
SKETCHES, STRIP = 2048, 256
#: Bits of the sieve of keys that several lines have.
KEY_BITS = 1 << 26
#: Pairs this near to ``similarity`` by hashes are checked by their shingles, as are those that two equal hashes could change.
MARGIN, EQUAL_HASHES = 1e-3, 2


def plain(line: str) -> str:
    return b" ".join(line.lower().encode().split()).decode()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX[2]
    return x ^ x >> np.uint64(33)


def shingle_sets(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all lines, by line and then rising; their lines; the size of each set."""
    gap = "\0" * (width - 1)   # a short line's window doesn't reach the next line
    chars = np.frombuffer(gap.join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in lines])
    first = np.cumsum(size + len(gap)) - size - len(gap)
    count = np.maximum(size - width + 1, 1)
    ahead = np.concatenate([chars, np.zeros(width, np.uint64)]) + np.uint64(1)
    h = np.zeros(len(chars), np.uint64)
    for j in range(width):
        h *= MIX[0]
        h += ahead[j:j + len(chars)]
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    h >>= np.uint64(64) - HASH_BITS
    # windows that would reach into the gap or past a line's end
    over = np.minimum(size + len(gap) - count, len(chars) - first - count)
    starts = np.ones(len(chars), bool)
    starts[np.arange(over.sum()) + np.repeat(first + count - np.cumsum(over) + over, over)] = False
    both = h[starts]
    both |= np.repeat(np.arange(len(lines), dtype=np.uint64) << HASH_BITS, count)
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    both = both[new]
    owner = (both >> HASH_BITS).view(np.int64)
    both &= (np.uint64(1) << HASH_BITS) - np.uint64(1)
    return both, owner, np.bincount(owner, minlength=len(lines))


def banded(minima: np.ndarray, salt: int) -> np.ndarray:
    """Keys of the bands: sets x bands from sets x bands x rows."""
    key = np.zeros(minima.shape[:2], np.uint64)
    for r in range(minima.shape[2]):
        key = mixed(key * MIX[0] + minima[:, :, r] + np.uint64(r))
    return mixed(key + np.arange(salt + 1, salt + 1 + key.shape[1], dtype=np.uint64) * MIX[1])


def bin_minima(h: np.ndarray, owner: np.ndarray, sets: int, o: Options) -> np.ndarray:
    """Minima of bins (0: an empty bin): sets x minima."""
    n = o.bands * o.rows
    place = (h >> np.uint64(12)) * np.uint64(n) >> HASH_BITS - np.uint64(12)
    cell = owner * n + place.astype(np.int64)
    least = np.concatenate([[True], cell[1:] != cell[:-1]])
    minima = np.zeros(sets * n, np.uint64)
    minima[cell[least]] = h[least] + np.uint64(1)
    return minima.reshape(sets, n)


def permuted_minima(h: np.ndarray, first: np.ndarray, o: Options) -> np.ndarray:
    """Minima under permutations, odd multiples of a mixed hash: sets x minima."""
    factors = np.random.default_rng(7).integers(0, 1 << 63, o.bands * o.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = mixed(h * MIX[0] + np.uint64(7))
    minima, y = np.empty((len(factors), len(first)), np.uint64), np.empty_like(x)
    for k, f in enumerate(factors):
        np.multiply(x, f, out=y)
        np.minimum.reduceat(y, first, out=minima[k])
    return np.ascontiguousarray(minima.T)


def keys_of_bins(minima: np.ndarray, o: Options) -> np.ndarray:
    """A band with more than one empty bin has no key."""
    minima = minima.reshape(len(minima), o.bands, o.rows)
    return np.where((minima > 0).sum(axis=2) >= o.rows - 1, banded(minima, 0), EMPTY)


def keys_of_permutations(minima: np.ndarray, o: Options) -> np.ndarray:
    return banded(minima.reshape(len(minima), o.bands, o.rows), o.bands)


def bin_keys(h: np.ndarray, owner: np.ndarray, sets: int, o: Options) -> np.ndarray:
    return keys_of_bins(bin_minima(h, owner, sets, o), o)


def permuted_keys(h: np.ndarray, first: np.ndarray, o: Options) -> np.ndarray:
    return keys_of_permutations(permuted_minima(h, first, o), o)


def words_of(o: Options) -> int:
    return -(-o.bands * o.rows // IN_WORD)


def sketched(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum: sets x words from sets x minima."""
    words = -(-minima.shape[1] // IN_WORD)
    bits = np.zeros((len(minima), words * IN_WORD), np.uint64)
    bits[:, :minima.shape[1]] = mixed(minima * MIX[0]) >> np.uint64(62)
    bits = bits.reshape(len(minima), words, IN_WORD) << np.arange(0, 2 * IN_WORD, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=2)


def most_differing(o: Options) -> int:
    """Minima whose bits differ in two sketches at most, but for ``LOST`` of the pairs at ``similarity``."""
    n, p, lost = o.bands * o.rows, (1 + 3 * o.similarity) / 4, 0.0
    for t in range(n):
        lost += comb(n, t) * p ** t * (1 - p) ** (n - t)
        if lost > LOST:
            return n - t
    return 0


def may_agree(a: str, b: str, o: Options) -> Column:
    """Whether sizes (``<a>size``) and sketches (``<a>w0`` ...) of two lines leave their similarity open."""
    differ = [f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {LOW}L)"
              for x in (f"({a}w{k} ^ {b}w{k})" for k in range(words_of(o)))]
    sizes = f"least({a}size, {b}size) >= {o.similarity}D * greatest({a}size, {b}size) - 1e-9D"
    return F.expr(f"{sizes} and {' + '.join(differ)} <= {most_differing(o)}")


def signed(lines: list[str], o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the shingle sets, 2 x bands keys of each (0: none) and the sketches of both kinds of minima.

    The lowest bit of a key says which kind it is of: 0 bins, 1 permutations.
    """
    with np.errstate(over="ignore"):
        h, owner, size = shingle_sets(lines, o.width)
        keys, words = np.zeros((len(lines), 2 * o.bands), np.uint64), words_of(o)
        sketch = np.zeros((len(lines), 2 * words), np.uint64)
        large, few = size >= o.similarity * o.small, size <= o.small
        if large.any():
            own = large[owner]
            minima = bin_minima(h[own], (np.cumsum(large) - 1)[owner[own]], int(large.sum()), o)
            keys[large, :o.bands] = keys_of_bins(minima, o) & ~np.uint64(1)
            sketch[large, :words] = sketched(minima)
        if few.any():
            minima = permuted_minima(h[few[owner]], np.cumsum(size[few]) - size[few], o)
            keys[few, o.bands:] = keys_of_permutations(minima, o) | np.uint64(1)
            sketch[few, words:] = sketched(minima)
    return size, keys, sketch


def signatures(lines: list[str], o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets, and 2 x bands keys of each (0: none)."""
    return signed(lines, o)[:2]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"),
                       F.col("text").cast("string").alias("text"))


def line_keys(x: str) -> tuple[int, int]:
    import xxhash
    h = xxhash.xxh3_128_intdigest(x.encode())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def places_of(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, tag, pos and two keys of the plain line."""

    def run(batches):
        for batch in batches:
            at, pos, k1, k2 = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for p, line in enumerate(text.split("\n") if text else ()):
                    if x := plain(line):
                        a, b = line_keys(x)
                        at.append(i)
                        pos.append(p)
                        k1.append(a)
                        k2.append(b)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()),
                 pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["doc_id", "tag", "pos", "k1", "k2"])

    return keyed(docs).mapInArrow(run, "doc_id long, tag long, pos int, k1 long, k2 long")


def chunks(lines: list[str]):
    """Stretches (from, to) of about ``CHUNK_CHARS`` characters."""
    start, n = 0, 0
    for k, x in enumerate(lines):
        n += len(x)
        if n >= CHUNK_CHARS:
            yield start, k + 1
            start, n = k + 1, 0
    if start < len(lines):
        yield start, len(lines)


def lines_of(docs: DataFrame, o: Options) -> DataFrame:
    """The lines of every batch: k1, k2, their places there (how many, and the first), size, keys and sketches."""
    names = [f"s{k}" for k in range(2 * words_of(o))]

    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[str, list] = {}
            for i, text in enumerate(batch.column(2).to_pylist()):
                for p, line in enumerate(text.split("\n") if text else ()):
                    if x := plain(line):
                        place = (ids[i] is None, ids[i] or 0, tags[i], p)
                        held = seen.get(x)
                        if held is None:
                            seen[x] = [1, place]
                        else:
                            held[0] += 1
                            held[1] = min(held[1], place)
            lines = list(seen)
            for a, b in chunks(lines):
                size, keys, sketch = signed(lines[a:b], o)
                given = keys != EMPTY
                ends = np.concatenate([[0], np.cumsum(given.sum(axis=1))]).astype(np.int32)
                own = [line_keys(x) for x in lines[a:b]]
                held = [seen[x] for x in lines[a:b]]
                z, d, t, p = zip(*(h[1] for h in held))
                columns = [pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()),
                           pa.array(size, pa.int64()), pa.array([h[0] for h in held], pa.int64()), pa.array(z, pa.bool_()),
                           pa.array(d, pa.int64(), mask=np.array(z)), pa.array(t, pa.int64()), pa.array(p, pa.int32()),
                           pa.ListArray.from_arrays(ends, keys[given].view(np.int64)),
                           *[pa.array(k.view(np.int64)) for k in np.ascontiguousarray(sketch.T)]]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "size", "places", "z", "doc_id", "tag", "pos", "keys",
                                                                 *names])

    return keyed(docs).mapInArrow(run, "k1 long, k2 long, size long, places long, z boolean, doc_id long, tag long, pos int, "
                                  "keys array<long>, " + ", ".join(f"{n} long" for n in names))


def shingle_set(x: str, width: int) -> set[str]:
    return {x[i:i + width] for i in range(max(1, len(x) - width + 1))}


def close(a: set, b: set, similarity: float) -> bool:
    """Jaccard similarity of two sets, by their sizes first."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(a & b)
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


@contextmanager
def shuffles_released(spark):
    """Shuffle files of a finished write go at once, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def overlaps(a: list[str], b: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of the shingle sets of pairs of lines, by hash, and the size of the smaller set."""
    with np.errstate(over="ignore"):
        h, owner, size = shingle_sets(a + b, width)
    both = np.sort((owner % len(a)).astype(np.uint64) << HASH_BITS | h)
    twice = both[1:][both[1:] == both[:-1]] >> HASH_BITS
    common = np.bincount(twice.astype(np.int64), minlength=len(a))
    size = size.reshape(2, -1)
    return common / (size.sum(axis=0) - common), size.min(axis=0)


def similar(a: list[str], b: list[str], o: Options) -> np.ndarray:
    """Which pairs of plain lines have ``similarity``."""
    same = np.zeros(len(a), bool)
    for lo, hi in chunks([x + y for x, y in zip(a, b)]):
        j, size = overlaps(a[lo:hi], b[lo:hi], o.width)
        margin = np.maximum(MARGIN, 2 * EQUAL_HASHES / size)
        same[lo:hi] = j >= o.similarity + margin
        for k in np.flatnonzero(np.abs(j - o.similarity) <= margin) + lo:
            same[k] = close(shingle_set(a[k], o.width), shingle_set(b[k], o.width), o.similarity)
    return same


def line_classes(docs: DataFrame, lines: DataFrame, nodes: DataFrame, o: Options) -> DataFrame:
    """Lines that belong to another line's component: node, root."""
    # equal lines of several batches: the keys of one of them count, and only the others' rows are shuffled
    again = stored(lines.select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti"), "line-again")

    def members(*columns):
        """A row for each key of a line."""
        flagged = sieve(lines.select("row", "keys", *columns), F.xxhash64("row"), again.select(F.xxhash64("row").alias("h")), "_maybe")
        once = (flagged.where("not _maybe").drop("_maybe")
                .union(flagged.where("_maybe").drop("_maybe").join(again, "row", "left_anti")))
        return once.select(F.col("row").alias("node"), F.explode("keys").alias("key"), *columns)

    words = words_of(o)
    own = [f"w{k}" for k in range(words)]

    def texts_of(wanted, name):
        """The text of lines, from one place of each: the lines wanted are cut out before anything is shuffled."""
        spot = [F.xxhash64("doc_id", "tag", "pos").alias("spot"), "tag", "pos"]
        need = stored(wanted.join(nodes.select("node", "f.doc_id", "f.tag", "f.pos"), "node").select("node", *spot), f"{name}-need")
        every = (keyed(docs).select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
                 .select(*spot, "line"))
        found = sieve(every, F.col("spot"), need.select("spot"), "_maybe").where("_maybe").drop("_maybe")
        at = ["spot", "tag", "pos"]
        return stored(found.dropDuplicates(at).join(need, at).select("node", "line"), f"{name}-texts")

    def verify(able, name):
        texts = texts_of(able.select(F.col("a").alias("node")).union(able.select(F.col("b").alias("node"))).distinct(), name)
        both = able.join(texts.selectExpr("node a", "line la"), "a").join(texts.selectExpr("node b", "line lb"), "b")

        def check(batches):
            for batch in batches:
                la, lb = ([plain(x) for x in batch.column(k).to_pylist()] for k in (2, 3))
                same = similar(la, lb, o)
                yield batch.select(["a", "b"]).filter(pa.array(same))

        return stored(both.select("a", "b", "la", "lb").mapInArrow(check, "a long, b long"), f"{name}-links")

    # the keys alone are in this shuffle, which every key goes through; few of them come twice in a task
    count = stored(members().select("key").repartition("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-sizes")
    # most buckets hold one node; their rows are dropped before the join's shuffle
    sketches = [F.expr(f"if(key & 1 = 0, s{k}, s{words + k})").alias(w) for k, w in enumerate(own)]
    shared = (sieve(members("size", *[f"s{k}" for k in range(2 * words)]), F.col("key"), count.select("key"), "_maybe", KEY_BITS)
              .where("_maybe").select("key", "node", "size", *sketches))
    sized = stored(shared.join(count, "key"), "line-buckets")
    at = ["node", "size", *own]
    pivots = sized.groupBy("key").agg(F.min(F.struct(*at)).alias("a_")).select("key", *[F.col(f"a_.{c}").alias(f"a_{c}") for c in at])
    star = (sized.join(pivots, "key").where("node <> a_node").where(may_agree("a_", "", o)).selectExpr("a_node a", "node b"))
    links = verify(stored(star.distinct(), "line-pairs"), "line")
    labels = stored(components(links, "line-classes"), "line-labels")

    # of small buckets the pairs that aren't in one class by now; those with the pivot have been compared
    small = (sized.where(F.col("n").between(3, SMALL_BUCKET)).join(pivots.select("key", "a_node"), "key").where("node <> a_node")
             .join(labels, "node", "left").select("key", *at, F.coalesce("root", "node").alias("root")))
    other = small.select("key", *[F.col(c).alias(f"a_{c}") for c in (*at, "root")])
    rest = (small.join(other, "key").where("a_node < node and a_root <> root").where(may_agree("a_", "", o))
            .selectExpr("a_node a", "node b"))
    links = links.union(verify(stored(rest.distinct(), "line-rest-pairs"), "line-rest"))
    labels = stored(components(links, "line-small"), "line-labels")

    # buckets above the limit that aren't one class by now, block against block
    large = stored(sized.where(F.col("n") > SMALL_BUCKET).join(labels, "node", "left")
                   .select("key", "n", *at, F.coalesce("root", "node").alias("root")), "line-large")
    open_ = large.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    columns = ["node", "root", "size", *own]

    def in_blocks(rows, size):
        """The rows of each two blocks of a bucket with one another: key, p, q, block and the rest."""
        cut = (rows.withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        return (cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                .withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("blocks", "other", "n"))

    limit = most_differing(o)

    def left_open(rows: pa.Table) -> pa.Table:
        """Nodes of two blocks that sizes and sketches don't keep apart from all nodes of other classes."""
        part = {c: rows.column(c).to_numpy() for c in rows.column_names}
        mine = part["block"] == part["p"]
        theirs = ~mine if part["p"][0] != part["q"][0] else mine
        node, root, size = part["node"], part["root"], part["size"]
        mine, theirs, found = np.flatnonzero(mine), np.flatnonzero(theirs), []
        for at in range(0, len(mine), STRIP):
            one = mine[at:at + STRIP, None]
            near = root[one] != root[theirs]
            near &= np.minimum(size[one], size[theirs]) >= o.similarity * np.maximum(size[one], size[theirs]) - 1e-9
            differ = np.zeros(near.shape, np.int16)
            for w in own:
                x = part[w].view(np.uint64)
                x = x[one] ^ x[theirs]
                x |= x >> np.uint64(1)
                differ += np.bitwise_count(x & np.uint64(LOW))
            near &= differ <= limit
            found += [node[one[near.any(axis=1), 0]], node[theirs[near.any(axis=0)]]]
        found = np.unique(np.concatenate(found)) if found else node[:0]
        return pa.table({"key": np.full(len(found), part["key"][0]), "node": found})

    # dealt out by blocks, so that a bucket isn't left to one task
    paired = in_blocks(large.join(open_, "key"), SKETCHES).select("key", "p", "q", "block", *columns)
    near = stored(paired.repartition("key", "p", "q").groupBy("key", "p", "q").applyInArrow(left_open, "key long, node long").distinct(), "line-near")
    if near.isEmpty():
        return labels.where("node <> root")
    held = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a line has 2 x bands keys at most; a pair that meets in several buckets is compared in one of them
    meets = near.groupBy("node").agg(F.collect_set("key").alias("keys"))
    more_texts = texts_of(meets.select("node"), "line-more")
    paired = (in_blocks(large.drop("n").join(near, ["key", "node"]).join(held, "key"), BLOCK).join(meets, "node").join(more_texts, "node")
              .select("key", "p", "q", *columns, "keys", "line"))

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between classes in two blocks of a bucket, enough to join what belongs together."""
        pdf = pdf.sort_values(["size", "root"], kind="stable")
        root, size, line = pdf["root"].tolist(), pdf["size"].tolist(), pdf["line"].tolist()
        sketch = np.ascontiguousarray(pdf[own].to_numpy()).view(np.uint64)
        met, here = np.concatenate(pdf["keys"].tolist()), pdf["key"].iat[0]
        at = np.repeat(np.arange(len(root)), [len(k) for k in pdf["keys"]])
        earlier = (met < here) & ((met ^ here) & 1 == 0)   # buckets of the same kind of minima, hence of the same sketches
        names, code = np.unique(met[earlier], return_inverse=True)
        shares = np.zeros((len(root), len(names)), np.float32)
        shares[at[earlier], code] = 1
        head, found, sets = {r: r for r in root}, [], {}

        def top(r):
            while head[r] != r:
                r = head[r]
            return r

        def set_of(i):
            if i not in sets:
                sets[i] = shingle_set(plain(line[i]), o.width)
            return sets[i]

        first = 0
        for i in range(len(root)):
            while size[first] < o.similarity * size[i] - 1e-9:   # too small for this and all that follow
                sets.pop(first, None)
                first += 1
            x = sketch[first:i] ^ sketch[i]
            differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(LOW)).sum(axis=1)
            elsewhere = shares[first:i] @ shares[i] > 0
            for j in (np.flatnonzero((differ <= limit) & ~elsewhere) + first).tolist():
                if top(root[i]) != top(root[j]) and close(set_of(i), set_of(j), o.similarity):
                    head[top(root[i])] = top(root[j])
                    found.append((min(root[i], root[j]), max(root[i], root[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = stored(paired.groupBy("key", "p", "q").applyInPandas(hold, "a long, b long").distinct(), "line-joined")
    return stored(components(links.union(more), "line-all"), "line-labels").where("node <> root")


def removals(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Positions of the lines that go, by document: doc_id, tag, gone (array of line numbers)."""
    with shuffles_released(docs.sparkSession):
        return _removals(docs, o)


def _removals(docs: DataFrame, o: Options) -> DataFrame:
    both = ["k1", "k2"]
    lines = stored(lines_of(docs, o).withColumn("row", F.monotonically_increasing_id()), "line-lines")
    nodes = stored(lines.groupBy(*both).agg(
        F.min("row").alias("node"), F.max("size").alias("size"), F.sum("places").alias("n"),
        F.min(F.struct("z", "doc_id", "tag", "pos")).alias("f")), "line-nodes")
    moved = line_classes(docs, lines, nodes, o)
    # of each component the first place; a line at one place only, without a component, is none of them
    named = nodes.select("node", *both, "n", "f").join(moved, "node", "left").withColumn("c", F.coalesce("root", "node"))
    kept = named.groupBy("c").agg(F.sum("n").alias("places"), F.min("f").alias("first")).where("places > 1")
    fate = stored(named.join(kept, "c").select(*both, "n", F.col("first.doc_id").alias("fd"), F.col("first.tag").alias("ft"),
                                               F.col("first.pos").alias("fp")), "line-fate")
    # lines at very many places, a bounded number, don't meet all their places in one task
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HOT > total
    places = sieve(places_of(docs), F.col("k1"), fate.select("k1"), "_maybe").where("_maybe").drop("_maybe")
    split = stored(places.join(F.broadcast(fate.where(often).drop("n").withColumn("hot", F.lit(True))), both, "left"), "line-places")
    columns = ["doc_id", "tag", "pos", "fd", "ft", "fp"]
    cold = split.where("hot is null").select("doc_id", "tag", "pos", *both).join(fate.where(~often).drop("n"), both)
    gone = (split.where("hot").select(columns).union(cold.select(columns))
            .where("not (doc_id <=> fd and tag = ft and pos = fp)"))
    return stored(gone.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, o: Options = Options(), counts: bool = False) -> DataFrame:
    """The documents with the removed lines taken out of ``text``; all columns as they were.

    ``counts`` adds n_lines and n_removed.
    """
    gone = removals(docs, o)
    names = {c: fresh(docs, c) for c in ("_tag", "_maybe", "_lines", "_d", "_t", "_gone")}
    tag, maybe, lines, d, t, g = names.values()
    gone = gone.select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.col("gone").alias(g))
    flagged = sieve(docs.withColumn(tag, F.xxhash64("text")), F.xxhash64(F.col("doc_id").cast("long"), F.col(tag)),
                    gone.select(F.xxhash64(d, t).alias("k")), maybe)
    extra = [fresh(docs, "n_lines"), fresh(docs, "n_removed")] if counts else []
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    sure = flagged.where(~F.col(maybe)).select(
        *docs.columns, *([F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias(extra[0]),
                          F.lit(0).cast("long").alias(extra[1])] if counts else []))
    # the split is made below the join, so that it is evaluated once a document
    open_ = (flagged.where(F.col(maybe)).withColumn(lines, F.split("text", "\n"))
             .join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(tag) == F.col(t)), "left"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g)), lambda i: F.col(lines)[i])
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rest = open_.select(
        *[text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns],
        *([F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(extra[0]),
           F.coalesce(F.size(g), F.lit(0)).cast("long").alias(extra[1])] if counts else []))
    return sure.union(rest)
