"""Shared folder, durable intermediate tables and small text helpers of the llm operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a local test session) a temporary one is
    made and set; on a cluster that is an error, since a machine-local folder is
    invisible to other machines.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="docloom-")
    sc.setCheckpointDir(made)
    return made


#: Bytes of rows that go to Python at a time, where the session leaves the setting as it comes.
BATCH_BYTES = 12 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in batches of about BATCH_BYTES: both sides hold a batch or two at a time."""
    if int(str(spark.conf.get(_BATCH_SETTING)).rstrip("b")) > 32 << 20:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


#: Roots of workspaces that hold tables, in the order they were opened.
_OPEN: list[str] = []


_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written to the shared folder; they cut lineage and survive lost executors.

    What was shuffled for a table goes as soon as it is written, not when the driver
    happens to collect its garbage: disk holds the tables and one step's shuffle.

    Results are read from them lazily, so an operator can't remove its own;
    whoever has written a result calls ``release`` with the mark taken before.
    """

    def __init__(self, spark: SparkSession, what: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom/{what}-{uuid.uuid4().hex}"
        _OPEN.append(self.root)

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP_SETTING, None)
        self.spark.conf.set(_CLEANUP_SETTING, "true")
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP_SETTING)
            else:
                self.spark.conf.set(_CLEANUP_SETTING, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def mark() -> int:
    """A place in the row of open workspaces, for ``release``."""
    return len(_OPEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes the workspaces opened since a mark; results that were not written yet are lost."""
    while len(_OPEN) > since:
        remove(spark, _OPEN.pop())


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


#: A table goes to all tasks by broadcast only up to this size, at BROADCAST_ROW bytes a row besides its own.
BROADCAST_BYTES, BROADCAST_ROW = 16 << 20, 64


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows (counted; it should be a written table) are proven small."""
    return F.broadcast(df) if df.count() * (row_bytes + BROADCAST_ROW) <= BROADCAST_BYTES else df


#: Bytes of one column that Python turns to objects at a time.
SLICE_BYTES = 4 << 20


def slices(batches, at: int = 0, limit: int = SLICE_BYTES):
    """The Arrow batches in slices of about ``limit`` bytes of the string or binary column ``at``; a longer value is a slice of its own."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            if last > first:
                yield b.slice(first, last - first)


class Numbers(dict):
    """Numbers of things as they come up; ``fresh`` holds those numbered since it was last cleared."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, x):
        n = self[x] = len(self)
        self.fresh.append(x)
        return n


def grown(a: np.ndarray, size: int) -> np.ndarray:
    """a with room for ``size`` entries."""
    return a if size <= len(a) else np.concatenate((a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)))


def keep_memory() -> None:
    """Lets this worker keep freed memory (glibc only): arrays that come and go in loops then cost no page faults."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 28)  # the size from which memory is mapped afresh
        mallopt(-1, 1 << 28)  # the size of free memory that goes back


def crc_mod(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


#: Keys that hold at least 1/HOT_SHARE of all rows are joined by broadcast: there are at most HOT_SHARE of them.
HOT_SHARE = 1_000


def join_by_share(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left join table on key, where table has one row a key and ``weight``, the key's number of rows.

    Hot keys go to every task (their number is bounded by HOT_SHARE), and their
    rows stay where they are; only the rows of other keys are shuffled. So no key
    gathers its rows in one task. ``key`` may be null: such rows find nothing.
    """
    others = [c for c in table.columns if c not in (key, weight)]
    hot = table.filter(F.col(weight) * HOT_SHARE >= total).select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_found"))
    cold = table.filter(F.col(weight) * HOT_SHARE < total).select(F.col(key).alias("_cold_key"), F.struct(*others).alias("_found"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    done = F.col("_found").isNotNull() | F.col(key).isNull()
    rest = met.filter(~done).select(*rows.columns).join(cold, F.col(key) == F.col("_cold_key"), "left")
    pick = [*rows.columns, *(F.col("_found")[c].alias(c) for c in others)]
    return met.filter(done).select(*pick).unionByName(rest.select(*pick))


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node that isn't the root of its component, from links (a, b).

    Alternates large and small stars until nothing changes; the root is the
    smallest node. Every round is a written table. A node's links meet in one
    task, as pairs of numbers: what is linked here are sets, not documents.
    """
    edges = ws.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        step += 1
        edges = ws.table(small, f"{name}-{step}")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if step > 1:
            ws.drop(f"{name}-{step - 2}")
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of float64 matrices (bytes in column ``m``, one a task) over a tree of tasks; a few reach the driver."""

    def add(batches):
        total = None
        for b in batches:
            for m in b.column(0):  # one at a time, without a copy
                part = np.frombuffer(m.as_buffer())
                total = part.copy() if total is None else np.add(total, part, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    n = parts.rdd.getNumPartitions()
    while n > 8:
        n = -(-n // 16)
        parts = parts.repartition(n).mapInArrow(add, "m binary")
    out = np.zeros(shape)
    for r in parts.collect():  # 8 rows at most
        out += np.frombuffer(r.m).reshape(shape)
    return out


def map_sum(df: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over partitions of what work(record batch, total) adds to an array of zeros."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            work(b, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return summed(df.mapInArrow(run, "m binary"), shape)
