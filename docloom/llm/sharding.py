"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are the equal texts. Their byte sizes are summed in Spark; only two sets
of items reach the driver, both bounded by parameters and not by the input:

* large groups, of at least ``capacity / BIG_FRACTION`` bytes; there are at most
  ``n_shards * BIG_FRACTION`` of them, since they fit into the total;
* ``BUNDLES`` bundles that hold the small groups, dealt by the hash of the text.

Best fit decreasing then puts each item, largest first, into the open bin with
the tightest sufficient remainder. The remainders are kept in a balanced tree
(a treap over (remainder, bin)). The capacity is the smallest at which at most
``n_shards`` bins are opened. A group larger than the mean of what is left
can't be balanced and gets a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, read

ROW_BYTES = 16
BUNDLES = 16384
BIG_FRACTION = 256
SLOT_BUCKETS = 64


class RemainderTree:
    """Treap over (remainder, bin): insert, and take the least entry with remainder >= size."""

    def __init__(self):
        self.root = None
        self.seed = 88172645463325252

    def _priority(self) -> int:
        x = self.seed
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.seed = x
        return x

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, remainder: int, number: int) -> None:
        a, b = self._split(self.root, (remainder, number))
        self.root = self._merge(self._merge(a, [(remainder, number), self._priority(), None, None]), b)

    def take(self, size: int):
        """Removes and returns the entry with the tightest remainder of at least size, or None."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            a, b = self._split(self.root, best)
            _, b = self._split(b, (best[0], best[1] + 1))
            self.root = self._merge(a, b)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size (sizes descending); None as soon as more than ``most`` bins would open."""
    tree, out, bins = RemainderTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if most is not None and bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        tree.insert(found[0] - size, found[1])
    return out


def pack(sizes: list[int], n_bins: int) -> list[int]:
    """Bins 0..n_bins-1 of sizes in descending order, near equal in total."""
    out, first, left = [0] * len(sizes), 0, sum(sizes)
    while first < min(len(sizes), n_bins - 1) and sizes[first] * (n_bins - first) >= left:
        out[first] = first
        left -= sizes[first]
        first += 1
    rest, bins = sizes[first:], n_bins - first
    if not rest:
        return out
    low = max(math.ceil(left / bins), rest[0])
    fine, step, got = None, 1e-4, None
    while got is None:  # the first slack in a doubling series that suffices, then halve back
        got, fine, step = best_fit_decreasing(rest, int(low * (1 + step)) + 1, bins), step, step * 2
    under = fine / 2
    for _ in range(3):
        middle = (under + fine) / 2
        again = best_fit_decreasing(rest, int(low * (1 + middle)) + 1, bins)
        under, fine, got = (under, middle, again) if again is not None else (middle, fine, got)
    out[first:] = [first + b for b in got]
    return out


def shard_by_bytes(spark: SparkSession, docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Null texts count as empty (their group is that of the empty text). Repeated
    rows each keep a slot of their own; null ids are kept. Other columns are not
    looked at, so their names can't clash. An empty table gives an empty result.
    Slots run by hash bucket, then id, then text; exact repeats of one row are
    interchangeable. No group of rows meets in one task: slots are numbered in
    ``SLOT_BUCKETS`` parts of each shard, with offsets from their counts.
    """
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = ws.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("h"),
        ),
        "rows",
    )
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("h"), F.lit(BUNDLES)).cast("int"))
    groups = rows.groupBy("h", "bundle").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // (n_shards * BIG_FRACTION)))
    items = groups.groupBy(F.when(F.col("bytes") >= least, F.col("h")).alias("h"), F.when(F.col("bytes") < least, F.col("bundle")).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    found = sorted(((r.bytes, bytes(r.h or b""), -1 if r.bundle is None else r.bundle) for r in items.collect()), reverse=True)
    bins = pack([x[0] for x in found], n_shards)
    big = spark.createDataFrame([(bytearray(h), b) for (_, h, k), b in zip(found, bins) if k < 0], "h binary, big_shard int")
    small = spark.createDataFrame([(k, b) for (_, _, k), b in zip(found, bins) if k >= 0], "bundle int, small_shard int")
    placed = (
        rows.join(F.broadcast(big), "h", "left")  # at most n_shards * BIG_FRACTION rows
        .join(F.broadcast(small), "bundle", "left")  # at most BUNDLES rows
        .select("doc_id", "size", "text_crc32", "h", F.coalesce("big_shard", "small_shard").alias("shard"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLOT_BUCKETS)).cast("int"))
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "h")
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "part"])  # n_shards * SLOT_BUCKETS rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_by_bytes of all documents, in 40 shards. Nulls, repeats and empty tables as there."""
    return shard_by_bytes(spark, read(spark, sf_dir, "documents"))
