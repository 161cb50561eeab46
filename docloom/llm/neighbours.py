"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on the driver on at most ``SAMPLE`` vectors (those with the
smallest hashes), so its leaves follow the table up to that bound; every vector is
indexed in the leaf that it descends to. A query visits leaves best bin first: a
priority queue holds the nodes by the distance of their centres. How many leaves is
calibrated: for ``CALIBRATION`` queries the exact neighbours are found among all
vectors, and the visits widen until ``TARGET`` of them lie in visited leaves.
A query goes on beyond that until its leaves hold k other vectors.

Leaves are gathered, in the order of the tree, into cells of about CHUNK vectors; a
query goes to a cell once, with the leaves that it visits there. Larger cells (a
leaf of a common vector) are cut into chunks by the hash of the id, and so are the
queries of a cell. Chunks are joined by (cell, chunk, chunk of queries), so no leaf
and no set of queries meets in one task whole; each pair of chunks yields at most
k rows a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, read

K = 10
SAMPLE = 32_768
BRANCHES = 8
LEAF_SAMPLE = 16
ROUNDS = 8
CALIBRATION = 256
TARGET = 0.94
CHUNK = 4096
SEED = 5


class Tree:
    """Hierarchical k-means; nodes in arrays, leaves numbered."""

    def __init__(self, sample: np.ndarray):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.rng = np.random.default_rng(SEED)
        self._grow(sample, sample.mean(axis=0) if len(sample) else sample.sum(axis=0))

    def _grow(self, x: np.ndarray, centre: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x) if len(x) > LEAF_SAMPLE else []
        if len(parts) < 2:
            self.leaf[node], self.leaves, parts = self.leaves, self.leaves + 1, []
        for part, c in parts:
            self.children[node].append(self._grow(part, c))
        return node

    def _split(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(x, axis=0)
        c = distinct[self.rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
        for _ in range(ROUNDS):
            own = _squares(x, c).argmin(axis=1)
            c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        own = _squares(x, c).argmin(axis=1)
        return [(x[own == j], c[j]) for j in range(len(c)) if (own == j).any()]

    def finish(self) -> "Tree":
        self.matrix = np.stack(self.centres)
        return self

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            own = _squares(x[rows], self.matrix[kids]).argmin(axis=1)
            todo += [(kid, rows[own == j]) for j, kid in enumerate(kids) if (own == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of a query, best bin first: ``most`` of them, and more until they hold ``least`` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        to_centre = ((self.matrix - q) ** 2).sum(axis=1).tolist()
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
            else:
                for kid in kids:
                    heapq.heappush(queue, (to_centre[kid], kid))
        return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None]


def nearest(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k nearest of x to q by exact distance, then id; rows of the id ``own`` are left out."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    keep = ids != own
    d, ids = d[keep], ids[keep]
    if len(d) > k:
        part = d <= np.partition(d, k - 1)[k - 1]
        d, ids = d[part], ids[part]
    order = np.lexsort((ids, d))[:k]
    return list(zip(d[order].tolist(), ids[order].tolist()))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) without null ids, null or empty vectors, zeros, or components that are null or not finite; exact repeats once."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)).dropDuplicates(["vec_id", "v"])


def neighbours(spark: SparkSession, rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all rows but its own.

    ``is_query`` is a condition on the column vec_id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part; neither do
    null ids, nor vectors of another length than the most frequent one. Exact
    repeats of a row count once; of a query id with several vectors the
    smallest vector asks. Ties go to the smaller id. Other columns are not
    looked at. An empty table gives an empty result.
    """
    ws = Workspace(spark, "neighbours")
    schema = "query_id long, rank int, vec_id long, score double"
    valid = ws.table(valid_vectors(rows, id_col, vector_col).withColumn("dim", F.size("v")), "valid")
    dims = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["dim"]
    valid = valid.filter(F.col("dim") == dim).drop("dim")
    hashed = F.xxhash64("vec_id", "v")
    chosen = valid.select(hashed.alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(SAMPLE).select("v").toArrow()
    tree = Tree(_vectors(chosen.column(0).combine_chunks(), dim)).finish()
    held = spark.sparkContext.broadcast(tree)  # SAMPLE bounds its nodes

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.descend(_vectors(b.column(1), dim))), *b.columns], names=["leaf", "vec_id", "v"])

    indexed = ws.table(valid.mapInArrow(assign, "leaf int, vec_id long, v array<double>"), "indexed")
    queries = ws.table(valid.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    visits = calibrated(tree, indexed, queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect(), dim, k)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row a leaf: at most SAMPLE
        sizes[r["leaf"]] = r["count"]
    cell_of = (np.cumsum(sizes) - sizes) // CHUNK  # leaves in the tree's order
    held_sizes = spark.sparkContext.broadcast((sizes, cell_of))

    def route(batches):
        sizes, cell_of = held_sizes.value
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            for i, x in enumerate(_vectors(b.column(1), dim)):
                leaves = np.array(held.value.visits(x, visits, sizes, k + 1))
                leaves = np.sort(leaves[sizes[leaves] > 0])
                cuts = np.flatnonzero(np.diff(cell_of[leaves])) + 1
                out += [(i, int(cell_of[part[0]]), part.tolist()) for part in np.split(leaves, cuts) if len(part)]
            at, cells, lists = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(cells, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "cell", "leaves"])

    routed = ws.table(queries.mapInArrow(route, "query_id long, v array<double>, cell int, leaves array<int>"), "routed")
    cells = spark.createDataFrame(list(enumerate(cell_of.tolist())), "leaf int, cell int")
    placed = indexed.join(F.broadcast(cells), "leaf")  # a row for each leaf: at most SAMPLE

    def chunks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    grid = ws.table(chunks(routed, "q_chunks").join(chunks(placed, "chunks"), "cell"), "grid")

    def chunked(df: DataFrame, key: str, leaves: str, own: str, other: str) -> DataFrame:
        """Rows of each cell in chunks of about CHUNK, once for each chunk of the other side."""
        df = df.join(F.broadcast(grid), "cell")  # a row for each cell: no more than leaves
        df = df.groupBy("cell", F.pmod(F.xxhash64(key), F.col(own + "s")).cast("int").alias(own)).agg(
            F.collect_list(key).alias("ids"), F.collect_list(leaves).alias("leaves"), F.flatten(F.collect_list("v")).alias("flat"), F.first(other + "s").alias("n")
        )
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    left = chunked(routed, "query_id", "leaves", "q_chunk", "chunk").select("cell", "q_chunk", "chunk", F.col("ids").alias("q_ids"), F.col("leaves").alias("q_leaves"), F.col("flat").alias("q_flat"))
    right = chunked(placed, "vec_id", "leaf", "chunk", "q_chunk").select("cell", "q_chunk", "chunk", "ids", "leaves", "flat")

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, leaf, q_ids = (np.asarray(b.column(c)[i].values) for c in (0, 1, 3))
                x, q = (np.asarray(b.column(c)[i].values).reshape(-1, dim) for c in (2, 5))
                out = []
                for own, vector, visited in zip(q_ids.tolist(), q, b.column(4)[i].values):
                    rows = np.flatnonzero(np.isin(leaf, np.asarray(visited.values)))
                    out += [(own, v, d) for d, v in nearest(vector, own, ids[rows], x[rows], k)]
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.join(right, ["cell", "q_chunk", "chunk"]).select("ids", "leaves", "flat", "q_ids", "q_leaves", "q_flat").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(tree: Tree, indexed: DataFrame, sample: list, dim: int, k: int) -> int:
    """Number of leaves to visit, from the exact neighbours of the sample among all vectors."""
    asked = [(r.vec_id, np.array(r.v)) for r in sample]
    if not asked:
        return 1

    def brute(batches):
        best: list[list] = [[] for _ in asked]
        for b in batches:
            leaf, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _vectors(b.column(2), dim)
            own = dict(zip(ids.tolist(), leaf.tolist()))
            for i, (q_id, q) in enumerate(asked):
                best[i] = heapq.nsmallest(k, best[i] + [(d, v, own[v]) for d, v in nearest(q, q_id, ids, x, k)])
        flat = [(i, *hit) for i, hits in enumerate(best) for hit in hits]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["i", "d", "vec_id", "leaf"])

    truth = indexed.mapInArrow(brute, "i int, d double, vec_id long, leaf int")
    truth = truth.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "vec_id"))).filter(F.col("rank") <= k)
    wanted = truth.select("i", "leaf").collect()  # CALIBRATION * k rows at most
    places = [{leaf: n for n, leaf in enumerate(tree.visits(q, tree.leaves))} for _, q in asked]
    needed = np.array([places[r.i][r.leaf] for r in wanted])
    visits = 1
    while visits < tree.leaves and len(needed) and (needed < visits).mean() < TARGET:
        visits = -(-visits * 11 // 10)
    return min(visits, tree.leaves)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbours of the rows of embeddings whose vec_id is divisible by 100. Nulls, odd vectors, ties, repeats and empty tables as there."""
    return neighbours(spark, read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)
