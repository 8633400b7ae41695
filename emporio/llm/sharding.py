"""Operator 1, sharding: minimax contiguous partition. DataFrame and SQL functions only.

Rows of equal text are one atomic group.  Groups stand in order of their
least doc_id; a binary search finds the smallest capacity for which a
greedy cut of that order into so many shards is feasible, and the cuts
are made there (law ``bytes``).

The groups' prefix sums stay distributed.  The search runs on a summary
of at most ``SUMMARY`` buckets of prefix sums: a greedy step that a
bucket can't decide is carried as a lower and an upper bound, which
leaves a narrow range of capacities; the next summary covers only the
stretches where their cuts can lie, until one capacity is left.

A group larger than an equal share gets a shard of its own and the
search goes on over the others (otherwise its size would be the
capacity, and the other shards would be filled up to it).

Defined results: NULL texts are one group of size 1 a row; a NULL doc_id
sorts first; repeated rows are one group and keep a slot each; fewer
groups than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored, text_key

#: Most buckets of a summary that the driver holds.
SUMMARY = 1 << 16


class Summary:
    """Least and greatest prefix sum of each non-empty bucket."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.low = sorted(a for a, _ in rows)
        self.high = sorted(b for _, b in rows)

    def floor(self, x: int, upper: bool) -> int:
        """The greatest prefix sum up to ``x``, from below or from above."""
        i = bisect_right(self.low, x) - 1
        if i < 0:
            return 0
        return self.high[i] if self.high[i] <= x else x if upper else self.low[i]


def cuts(s: Summary, capacity: int, shards: int, total: int, upper: bool) -> list[int]:
    """Ends of the greedy shards."""
    at, out = 0, []
    for _ in range(shards):
        if at + capacity >= total:
            out.append(total)
            break
        at = s.floor(at + capacity, upper)
        out.append(at)
    return out


def least_true(low: int, high: int, test) -> int:
    while low < high:
        mid = (low + high) // 2
        if test(mid):
            high = mid
        else:
            low = mid + 1
    return low


def smallest_capacity(prefix: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """Cut points (prefix sums) of the smallest feasible capacity."""
    low, high = max(largest, -(-total // shards)), total // shards + largest
    spans = [(0, total)]
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in spans) // SUMMARY))
        bucket, base = F.lit(None).cast("long"), 0
        for a, b in spans:
            bucket = F.when(F.col("upto").between(a, b), F.lit(base) + F.floor((F.col("upto") - a) / width))\
                .otherwise(bucket)
            base += (b - a) // width + 1
        rows = (prefix.select(bucket.alias("b"), "upto").where("b is not null").groupBy("b")
                .agg(F.min("upto").alias("low"), F.max("upto").alias("high")).collect())
        s = Summary([(r["low"], r["high"]) for r in rows])

        def feasible(c, upper):
            return cuts(s, c, shards, total, upper)[-1] == total

        low = least_true(low, high, lambda c: feasible(c, True))       # below it surely infeasible
        high = least_true(low, high, lambda c: feasible(c, False))     # surely feasible
        first, last = cuts(s, low, shards, total, False), cuts(s, high, shards, total, True)
        if low == high and cuts(s, low, shards, total, False) == cuts(s, low, shards, total, True):
            return first[:-1]
        first += [total] * (shards - len(first))
        last += [total] * (shards - len(last))
        spans = joined([(a, min(b, total)) for a, b in zip(first, last)])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        # a NULL text has a key of its own; md5 never gives an empty one
        F.coalesce(text_key(), F.lit(b"")).alias("_key")), "shard-rows")
    groups = stored(rows.groupBy("_key").agg(F.sum("size").alias("_size"), F.min("doc_id").alias("_first"),
                                             F.count(F.lit(1)).alias("_n")), "shard-groups")
    total, n = groups.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()

    # groups above an equal share of what is left: fewer than there are shards
    own = []
    for r in groups.orderBy(F.desc("_size"), "_key").limit(shards).collect():
        left = shards - len(own)
        if left == 1 or r["_size"] * left <= total:
            break
        own.append(bytes(r["_key"]))
        total -= r["_size"]

    small = groups.where(~F.col("_key").isin(own)) if own else groups
    spread = stored(small.repartitionByRange("_first", "_key").sortWithinPartitions("_first", "_key")
                    .withColumn("_mid", F.monotonically_increasing_id())
                    .withColumn("_pid", F.shiftrightunsigned("_mid", 33)), "shard-ordered")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy("_pid").agg(F.sum("_size").alias("_sum"))  # one row per partition
               .select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off")))
    upto = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    prefix = stored(spread.withColumn("_run", F.sum("_size").over(upto)).join(F.broadcast(offsets), "_pid")
                    .select("_key", "_n", "_size", (F.col("_run") + F.col("_off")).alias("upto")), "shard-prefix")
    largest = prefix.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]
    ends = smallest_capacity(prefix, shards - len(own), total, largest) if total else []
    number = sum([(F.col("upto") > e).cast("int") for e in ends], F.lit(len(own)))
    placed = prefix.select("_key", "_n", number.cast("int").alias("shard"))

    # a group with more than one row in 64 is looked up in a list of at most 64 and `shards` groups
    many = placed.where(F.col("_n") * 64 > n).select("_key", "shard")
    few = placed.where(F.col("_n") * 64 <= n).select("_key", "shard")
    if own:
        listed = F.array(*[F.struct(F.lit(k).alias("_key"), F.lit(i).alias("shard")) for i, k in enumerate(own)])
        many = many.union(docs.sparkSession.range(1).select(F.inline(listed)))
    looked = rows.join(F.broadcast(many), "_key", "left")
    found = (looked.where("shard is not null")
             .unionByName(looked.where("shard is null").drop("shard").join(few, "_key")))
    return (ranked(found, ["shard"], ["doc_id", "_key"], "slot", "shard-slots")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
