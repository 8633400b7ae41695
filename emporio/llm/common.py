"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor repeats tasks of the running job
    only, never the steps before this table.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """``rank`` = 0-based position of a row among rows of equal ``by``, in ``order``.

    No window over a whole group: rows are range-partitioned on
    (``by``, ``order``), so a hot group is spread over many tasks; the
    position inside a partition comes from ``monotonically_increasing_id``
    and the offsets from counts per (partition, group), at most one row
    per partition and per group boundary.  ``by`` must have a bounded
    number of values (shards, lengths).
    """
    spread = (df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = stored(spread, name)
    tagged = fixed.withColumn("_pid", F.shiftrightunsigned("_mid", 33))
    runs = tagged.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = (Window.partitionBy(*by).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select(*by, "_pid", "_m0",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), [*by, "_pid"])
            .withColumn(rank, F.col("_mid") - F.col("_m0") + F.col("_off"))
            .drop("_mid", "_pid", "_m0", "_off"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str | Column = "text") -> Column:
    """16-byte identity of a text; NULL stays NULL."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


#: Edges up to this number (2 MB) are joined on the driver; rounds of so few rows are all overhead.
FEW_EDGES = 1 << 17


def joined(a: list[int], b: list[int]) -> dict[int, int]:
    """The least node of the component of each node of the edges."""
    head = {x: x for x in (*a, *b)}

    def top(x):
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for u, v in zip(a, b):
        u, v = top(u), top(v)
        head[max(u, v)] = min(u, v)
    return {x: top(x) for x in head}


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) per node, root = least node.

    Few edges are joined on the driver, more by rounds over the cluster.

    Distributed union-find by alternating large-star and small-star
    steps: each step is one minimum per node and one join, every node
    ends up pointing at the least node of its component, and neighbour
    lists are never gathered.  Each round is written to the shared
    folder.  Stops when a round changes nothing.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .distinct(), f"{name}-edges")
    spread = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = e.agg(*spread).first()
    if not before[0]:   # no edge, no rounds
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if before[0] <= FEW_EDGES:
        few = e.toPandas()
        rows = list(joined(few["u"].tolist(), few["v"].tolist()).items())
        return stored(e.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["node", "root"]), "node long, root long"),
                      f"{name}-few")
    for k in range(max_rounds):
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, f"{name}-round{k}")
        after = e.agg(*spread).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


#: Bits of a sieve: 262,144 rows of 64 bits are broadcast, whatever the number of keys.
SIEVE_BITS = 1 << 24


def sieve(df: DataFrame, key: Column, keys: DataFrame, flag: str, bits: int = SIEVE_BITS) -> DataFrame:
    """Adds ``flag``: false where the 64-bit hash ``key`` is surely not among ``keys`` (one long column).

    A bitmap of fixed size over the hashes is broadcast, so that rows
    which a later join can't touch need no shuffle.  The join decides;
    with very many keys more rows are flagged, and none is lost.
    """
    at, word, mask = (fresh(df, c) for c in ("_at", "_word", "_mask"))
    words = (keys.select(F.pmod(F.col(keys.columns[0]), F.lit(bits)).alias(at))
             .selectExpr(f"{at} div 64 as {word}", f"shiftleft(1L, cast({at} % 64 as int)) as {mask}")
             .groupBy(word).agg(F.bit_or(mask).alias(mask)))
    return (df.withColumn(at, F.pmod(key, F.lit(bits))).withColumn(word, F.expr(f"{at} div 64"))
            .join(F.broadcast(words), word, "left")
            .withColumn(flag, F.expr(f"coalesce(({mask} & shiftleft(1L, cast({at} % 64 as int))) <> 0, false)"))
            .drop(at, word, mask))


#: Buckets up to this size are compared pair by pair, which is linear in the rows.
SMALL_BUCKET = 16
#: Nodes of a block in the comparison of large buckets.
BLOCK = 256


def bucket_classes(members: DataFrame, verify, compare, name: str) -> DataFrame:
    """Classes of similar nodes: rows (node, root) from distinct buckets ``members(key, node)``.

    All pairs of a large bucket are never made.

    1. Buckets of at most ``SMALL_BUCKET`` nodes give their pairs, larger
       ones a star around their least node.  ``verify(pairs(a, b), name)``
       returns the pairs that are similar, and these give first classes.
    2. Large buckets that share nodes form clusters.  A cluster that is
       one class by now is done.  The others are cut into blocks of about
       ``BLOCK`` nodes by hash, and ``compare(nodes, name)`` holds block
       against block: rows (a, b) of classes with a similar pair, at most
       one for each node and class.

    Every pair that shares a bucket and isn't in one class already has
    been compared, so no link is lost; memory is bounded by two blocks.
    """
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"),
                   f"{name}-sizes")
    # most buckets hold one node; their rows are dropped before the join's shuffle
    shared = sieve(members, F.col("key"), sizes.select("key"), "_maybe").where("_maybe").drop("_maybe")
    sized = stored(shared.join(sizes, "key"), f"{name}-buckets")
    small = sized.where(F.col("n") <= SMALL_BUCKET).select("key", "node")
    pairs = (small.selectExpr("key", "node a").join(small.selectExpr("key", "node b"), "key").where("a < b")
             .select("a", "b"))
    star = sized.where((F.col("n") > SMALL_BUCKET) & (F.col("node") != F.col("pivot"))).selectExpr("pivot a", "node b")
    tested = stored(pairs.union(star).distinct(), f"{name}-pairs")
    links = verify(tested, name)
    labels = stored(components(links, f"{name}-classes"), f"{name}-labels")
    if sizes.where(F.col("n") > SMALL_BUCKET).isEmpty():   # every pair of every bucket has been compared
        return labels

    clusters = components(star.distinct(), f"{name}-clusters").withColumnRenamed("root", "cluster")
    placed = stored(clusters.join(labels, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")),
                    f"{name}-placed")
    open_ = (placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
             .where("r0 <> r1").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    nodes = stored(placed.join(open_, "cluster")
                   .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), f"{name}-open")
    if nodes.isEmpty():
        return labels
    more = stored(compare(nodes, name), f"{name}-more")
    return stored(components(links.union(more.select("a", "b")), f"{name}-all"), f"{name}-labels")
