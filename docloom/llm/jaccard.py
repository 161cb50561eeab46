"""N-gram Jaccard join: a grouped prefix join over word shingles, and its components.

Two sets with a Jaccard similarity of at least t share an element among the
first ``n - ceil(t n) + 1`` of either, in any order common to both. The order
here puts rare shingles first, so that passages which many documents share
don't meet in the prefixes:

1. Documents with equal sets are one node. A node lists the shingles whose hash
   is in a fixed band of the hash space (with more hashes where a short text
   has too few there for its prefix); all others come later in the order.
2. Document frequencies of the listed shingles are counted over all nodes, range
   by range of the hashes (see ``_meeting``). The order is: the band by
   frequency then hash, then the rest by hash. Shingles that one node alone has
   fill the front of a prefix and find nobody.
3. Nodes with equal size and equal prefixes form a group; groups meet in the
   lists of their prefix shingles, and pairs of groups of compatible size are
   expanded to their members.
4. Candidates are verified on the whole sets. Pairs of short lists are written
   out. Long lists, which large groups of near copies make, are not paired off
   (see ``_links_of_long_lists``).

Large groups, long lists and frequent sets are joined by share: the few keys
with many rows go to all tasks, and their rows stay dealt out. Hashes cross the
network packed, a row for each range of a slice, and are dropped from the tables
of rows and nodes as soon as they have been counted.
Shingles are compared by 48 bits of a 64-bit hash: two different ones of a pair
are taken for equal with a probability of 2^-48.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Workspace, components, if_small, join_by_share, map_sum, read, slices

WORDS = 5
PERCENT = 80
#: Part of the 48-bit hash space whose shingles are ordered by frequency; over 1 - PERCENT/100, so that it nearly always holds the prefix.
BAND = 0.3
HASH_BITS = 48
#: Nodes of a list whose pairs are written out; longer lists are treated otherwise.
SHORT_LIST = 64
#: Nodes of a long list that all its nodes are compared with first.
PIVOTS = 4
#: Rows that one copy of a pivot's set serves.
PIVOT_ROWS = 1024
#: Shingles of a block of nodes that is compared with another block.
BLOCK_SHINGLES = 65_536
#: Shingles that are counted at a time.
RANGE_SHINGLES = 500_000
#: Nodes of the sample that shows frequent shingles, and the number of them that makes one frequent.
SAMPLE_NODES, OFTEN = 4096, 64
COLUMNS = 8192
#: Words whose hashes a task keeps.
CACHE_WORDS = 120_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def _word(self, w: bytes) -> int:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        x = self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return x

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        get = self.known.get
        w = np.fromiter([get(x) or self._word(x) for x in words], np.uint64, len(words))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * _M1
            h ^= h >> np.uint64(29)
        h *= _M2
        return np.unique(h ^ (h >> np.uint64(32)))


def prefix_length(n, percent: int = PERCENT):
    return n - (n * percent + 99) // 100 + 1


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - HASH_BITS)


def shingled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """key, n, node key, band size and the listed hashes (packed) of every row of docs (key, text)."""
    limit = np.uint64(int(BAND * (1 << HASH_BITS)))
    schema = f"key {docs.schema['key'].dataType.simpleString()}, n int, node binary, n_band int, listed binary"

    def run(batches):
        s = Shingler(words)
        for b in slices(batches, 1):
            n, key, band, lists = [], [], [], []
            for text in b.column(1).to_pylist():
                h = s.hashes(text)
                hs = short(h)  # ascending as h is; equal ones are kept apart by nothing, so dropped
                hs = hs[np.r_[True, hs[1:] != hs[:-1]]] if len(hs) else hs
                inside = int(np.searchsorted(hs, limit))
                listed = hs[: max(inside, min(len(hs), prefix_length(len(h), percent)))] if len(h) else hs
                n.append(len(h))
                key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                band.append(inside)
                lists.append(as_bytes(listed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(band, pa.int32()), pa.array(lists, pa.binary())], names=["key", "n", "node", "n_band", "listed"])

    return docs.select("key", "text").mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the sets of hashes x and y reach the similarity."""
    shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def checked(pairs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (a, b, set_a, set_b)."""

    def check(batches):
        for b in slices(batches, 2):
            keep, last, mine = [], None, None
            for i, (x, p, q) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3)))):
                if x != last:
                    last, mine = x, unpacked(p)
                if similar(mine, unpacked(q), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def packed(h: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return as_bytes(short(h))


def as_bytes(short_hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(short_hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // HASH_BITS, 8), np.uint8)
    out[:, : HASH_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BITS // 8)
    return out.view("<u8").ravel()


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rid, packed set) of the wanted (rid, node, rep); docs: (key, text)."""

    def run(batches):
        s = Shingler(words)
        for b in slices(batches, 2):
            rid, out = [], []
            for r, node, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                h = s.hashes(text)
                if hashlib.blake2b(h.tobytes(), digest_size=16).digest() == node:  # keys may repeat
                    rid.append(r)
                    out.append(packed(h))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(out, pa.binary())], names=["rid", "packed"])

    found = docs.join(if_small(wanted, 64), docs["key"].eqNullSafe(wanted["rep"])).select("rid", "node", "text")
    return found.mapInArrow(run, "rid long, packed binary").groupBy("rid").agg(F.first("packed").alias("packed"))


def fits(n, m, percent: int):
    """Sizes that a similar pair can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _labelled(ws: Workspace, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, n, root) of every row of docs (key, text): its number of shingles and the smallest key of its component (its own without shingles)."""
    listed = ws.table(shingled(docs, words, percent), "listed")
    rows = ws.table(listed.select("key", "n", "node"), "rows")
    nodes = ws.table(
        listed.filter("n > 0")
        .groupBy("node")
        .agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("n_band").alias("n_band"), F.first("listed").alias("listed"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "listed-nodes",
    )
    ws.drop("listed")
    prefixes = _prefixes(ws, nodes, percent)
    nodes = ws.table(nodes.select("rid", "node", "rep", "copies"), "nodes")
    ws.drop("listed-nodes")
    roots = _roots(ws, docs, nodes, prefixes, words, percent)
    labelled = nodes.select("rid", "node", "rep", "copies").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    sizes = ws.table(labelled.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("k")), "roots")
    table = join_by_share(labelled.select("node", "copies", "root"), sizes, "root", "k", nodes.count())
    table = ws.table(table.select("node", "copies", "least"), "labels")
    ws.drop("nodes", "roots")
    out = join_by_share(rows.select("key", "n", "node"), table, "node", "copies", rows.count())
    return out.select("key", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("root"))


def similar_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Texts of fewer than ``words`` words have the whole sequence as their one
    shingle. Null and blank texts have none; they are linked with nothing and
    are their own component. component_id is the smallest id that links reach;
    null ids count for nothing in it (null if a component has no other). Rows
    with repeated ids each get a row. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    out = _labelled(Workspace(spark, "jaccard"), docs, words, percent)
    return out.select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("root").alias("component_id"))


def _meeting(rows: DataFrame) -> DataFrame:
    """(h, rid, size, k): the hashes that at least two heads hold, with the number of rows and of heads that hold them.

    rows: a written table (rid, head, listed), each with distinct packed hashes; head is
    a boolean. Hashes go to ranges of about RANGE_SHINGLES by their low bits, as a packed
    row for each range of a slice. Those that OFTEN rows of a sample hold are counted
    first, by all tasks, and their rows stay dealt out, so no range has a longer list
    than about one of SAMPLE_NODES / OFTEN rows.
    """
    spark = rows.sparkSession
    count, total = rows.agg(F.count(F.lit(1)), F.sum(F.length("listed"))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) * 8 // HASH_BITS // RANGE_SHINGLES), 1)

    def flat(b):
        """Hashes of a slice (rid, head, listed) and the place of each one's row."""
        lists = b.column(2).to_pylist()
        return unpacked(b"".join(lists)), np.repeat(np.arange(len(lists)), [len(x) * 8 // HASH_BITS for x in lists])

    def tally(batches):
        for b in slices(batches, 2):
            s, c = np.unique(flat(b)[0].astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c)], names=["h", "c"])

    sample = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(max(1, count // SAMPLE_NODES))) == 0)
    found = sample.select("rid", "head", "listed").mapInArrow(tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN)
    often = np.sort(np.array([r.h for r in found.select("h").collect()], np.uint64))  # at most the sample's hashes / OFTEN

    def at(s):
        """The place of each hash in often, and whether it is there."""
        i = np.minimum(np.searchsorted(often, s), len(often) - 1)
        return i, often[i] == s

    def add(b, total):
        for x in slices([b], 2):
            s, row = flat(x)
            i, there = at(s)
            total[0] += np.bincount(i[there], minlength=len(often))
            heads = there & x.column(1).to_numpy(zero_copy_only=False)[row]
            total[1] += np.bincount(i[heads], minlength=len(often))

    known = map_sum(rows.select("rid", "head", "listed"), add, (2, len(often))).astype(np.int64) if len(often) else None

    def spread(batches):
        for b in slices(batches, 2):
            s, row = flat(b)
            rid, head = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            place = (((s & np.uint64((1 << 24) - 1)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)
            if len(often):
                place[at(s)[1]] = ranges + int(rid[0]) % (1 << 30)
            order = np.argsort(place, kind="stable")
            place, start = np.unique(place[order], return_index=True)
            parts = [order[x:y] for x, y in zip(start, [*start[1:], len(order)])]
            steps = [np.diff(rid[row[p]], prepend=0).astype(np.int64).tobytes() for p in parts]  # small numbers, which shrink
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([as_bytes(s[p]) for p in parts], pa.binary()), pa.array(steps, pa.binary()), pa.array([np.packbits(head[row[p]]).tobytes() for p in parts], pa.binary())], names=["place", "s", "rids", "heads"])

    def together(batches):
        rows = (r for b in slices(batches, 1) for r in zip(*(c.to_pylist() for c in b.columns)))
        for place, own in groupby(rows, key=lambda r: r[0]):
            for part in [list(own)] if place < ranges else ([r] for r in own):
                s = unpacked(b"".join(r[1] for r in part))
                rid = np.concatenate([np.cumsum(np.frombuffer(r[2], np.int64)) for r in part])
                if place < ranges:
                    head = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(r[2]) // 8) for r in part])
                    _, i, size = np.unique(s, return_inverse=True, return_counts=True)
                    size, k = size[i], np.bincount(i, weights=head).astype(np.int64)[i]
                else:
                    size, k = known[:, at(s)[0]]
                keep = k > 1
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (s, rid, size, k)], names=["h", "rid", "size", "k"])

    ranged = rows.select("rid", "head", "listed").mapInArrow(spread, "place long, s binary, rids binary, heads binary")
    return ranged.repartition("place").sortWithinPartitions("place").mapInArrow(together, "h long, rid long, size long, k long")


def _prefixes(ws: Workspace, nodes: DataFrame, percent: int) -> DataFrame:
    """(rid, n, prefix): the shingles of each node's prefix that another node lists too, packed; no row where there are none."""
    inside = F.col("h") < int(BAND * (1 << HASH_BITS))
    posts = ws.table(_meeting(nodes.select("rid", F.lit(True).alias("head"), "listed")).select("h", "rid", F.col("size").alias("df")), "shared")
    mine = Window.partitionBy("rid")
    at = F.row_number().over(mine.orderBy(~inside, "df", "h")) + F.col("n_band") - F.count(F.when(inside, 1)).over(mine)  # before it: what one node alone has
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    kept = posts.join(nodes.select("rid", "n", "n_band"), "rid").withColumn("at", at).filter(~inside | (F.col("at") <= length))

    def pack(batches):
        for b in batches:
            prefix = [as_bytes(h.values.to_numpy(zero_copy_only=False)) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prefix, pa.binary())], names=["rid", "n", "prefix"])

    lists = kept.groupBy("rid", "n").agg(F.sort_array(F.collect_list("h")).alias("h"))
    prefixes = ws.table(lists.mapInArrow(pack, "rid long, n int, prefix binary"), "prefixes")
    ws.drop("shared")
    return prefixes


def _roots(ws: Workspace, docs: DataFrame, nodes: DataFrame, prefixes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components of nodes, but for the roots themselves."""
    # groups of equal size and prefix; g is the smallest member
    keys = prefixes.select("rid", "n", F.concat(F.unhex(F.md5("prefix")), F.unhex(F.lpad(F.hex("n"), 8, "0"))).alias("prefix"))
    sizes = ws.table(keys.groupBy("prefix").agg(F.min("rid").alias("g"), F.count(F.lit(1)).alias("copies")).withColumn("members", F.col("copies")), "sizes")
    groups = ws.table(join_by_share(keys, sizes, "prefix", "copies", keys.count()).select("rid", "n", "g", "members"), "groups")
    # lists of at least two groups, and the groups of several members themselves
    own = ws.table(prefixes.join(groups.select("rid", "g"), "rid").select("rid", (F.col("rid") == F.col("g")).alias("head"), F.col("prefix").alias("listed")), "own")
    found = _meeting(own).join(groups.select("rid", "n", "g"), "rid")
    inner = groups.filter("members > 1").select((-F.col("g") - 1).alias("h"), "rid", "n", "g", F.col("members").alias("size"))
    posts = ws.table(found.select("h", "rid", "n", "g", "size").unionByName(inner), "posts")
    ws.drop("prefixes", "sizes", "own")
    wanted = ws.table(posts.select("rid").distinct().join(nodes.select("rid", "node", "rep"), "rid"), "wanted")
    sets = ws.table(whole_sets(docs, wanted, words), "sets")

    # pairs of groups that meet in short lists, expanded; pairs within small groups
    heads = posts.filter((F.col("size") <= SHORT_LIST) & (F.col("h") >= 0) & (F.col("rid") == F.col("g"))).select("h", "g", "n")
    met = heads.join(heads.select("h", F.col("g").alias("g2"), F.col("n").alias("m")), "h").filter((F.col("g") < F.col("g2")) & fits(F.col("n"), F.col("m"), percent)).select("g", "g2").distinct()
    members = groups.filter(F.col("members") <= SHORT_LIST).select("g", "rid")
    pairs = met.join(members.withColumnRenamed("rid", "a"), "g").join(members.select(F.col("g").alias("g2"), F.col("rid").alias("b")), "g2").select("a", "b")
    several = groups.filter((F.col("members") > 1) & (F.col("members") <= SHORT_LIST)).select("g", "rid")
    pairs = ws.table(pairs.union(several.join(several.withColumnRenamed("rid", "b"), "g").filter("rid < b").select("rid", "b")), "pairs")
    joined = pairs.join(sets.select(F.col("rid").alias("b"), F.col("packed").alias("set_b")), "b").join(sets.select(F.col("rid").alias("a"), F.col("packed").alias("set_a")), "a")
    links = ws.table(checked(joined, percent), "links")
    ws.drop("wanted", "pairs", "groups")

    long = posts.filter(F.col("size") > SHORT_LIST).select("h", "rid")
    if not long.isEmpty():
        links, rest = _links_of_long_lists(ws, long, links, sets, percent)
        if rest is None:
            return links
        links = links.unionByName(rest)
    roots = components(ws, links, "all")
    ws.drop("posts", "sets")
    return roots


def _links_of_long_lists(ws: Workspace, posts: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links that make up the components within lists (h, rid) that are too long to pair off.

    1. A node can be similar to others of the lists only if ``percent`` of its
       shingles occur in another of their nodes too. This bound, on whole sets,
       takes out what shares a passage or strays too far from a group's core.
    2. Every node left is compared with its lists' PIVOTS, the nodes with the
       fewest shingles of their own: linear in the lists.
    3. Lists whose nodes are then in one component are done. In the others,
       nodes outside the list's largest component are compared with all nodes of
       other components, block by block, without a row for a pair; only links
       that join two components of the blocks come back.

    Returns (roots, None) if the second step settles all, else all links in two parts.
    """
    size = F.length("packed") * 8 / HASH_BITS
    nodes = ws.table(posts.select("rid").distinct().join(sets, "rid").withColumn("n", size.cast("int")), "long-sets")

    ranges = max(1, -(-(nodes.agg(F.sum("n")).first()[0] or 0) // RANGE_SHINGLES))

    def spread(batches):
        """Shingles and their nodes by range of the hash space, packed: a row for each range of a slice."""
        for b in slices(batches, 1, 1 << 20):
            arrays = [unpacked(p) for p in b.column(1).to_pylist()]
            s, rid = np.concatenate(arrays), np.repeat(np.asarray(b.column(0)), [len(a) for a in arrays])
            place = ((s >> np.uint64(HASH_BITS - 24)) * np.uint64(ranges)) >> np.uint64(24)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(ends)).tolist()
            parts = [order[ends[i] : ends[i + 1]] for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (s.astype(np.int64), rid.astype(np.int64)))], names=["place", "s", "rids"])

    def single(batches):
        """(rid, alone) from the rows of each range together: a node's shingles that no other node has."""
        rows = (r for b in slices(batches, 1) for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, own in groupby(rows, key=lambda r: r[0]):  # about RANGE_SHINGLES
            own = list(own)
            s, rid = (np.concatenate([np.frombuffer(r[c], np.int64) for r in own]) for c in (1, 2))
            _, first, count = np.unique(s, return_index=True, return_counts=True)
            rids, n = np.unique(rid[first[count == 1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(n.astype(np.int64))], names=["rid", "alone"])

    packed_ranges = nodes.select("rid", "packed").mapInArrow(spread, "place int, s binary, rids binary").repartition("place").sortWithinPartitions("place")
    alone = packed_ranges.mapInArrow(single, "rid long, alone long").groupBy("rid").agg(F.sum("alone").alias("alone"))
    kept = nodes.select("rid", "n").join(alone, "rid", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    kept = ws.table(kept, "long-kept")
    posts = ws.table(posts.join(kept, "rid").select("h", "rid", "n", "alone"), "long")
    total = posts.count()
    # of lists that hold the same nodes (told apart by 128 bits) one stays
    lists = posts.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "rid")).alias("y"))
    lists = ws.table(lists.groupBy("rows", "x", "y").agg(F.min("h").alias("h")).filter("rows > 1").select("h", "rows"), "long-lists")

    order = Window.partitionBy("h").orderBy(F.col("alone") / F.col("n"), "rid")
    pivots = posts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PIVOTS).groupBy("h").agg(F.collect_list(F.struct(F.col("rid").alias("a"), F.col("n").alias("m"))).alias("pivots"))
    pivots = ws.table(pivots.join(lists, "h"), "pivots")
    stars = join_by_share(posts.select("h", "rid", "n"), pivots, "h", "rows", total).select(F.col("rid").alias("b"), "n", F.explode("pivots").alias("p")).select(F.col("p.a").alias("a"), "b", "n", F.col("p.m").alias("m"))
    stars = ws.table(stars.filter((F.col("a") != F.col("b")) & fits(F.col("n"), F.col("m"), percent)).select("a", "b").distinct(), "stars")
    counts = ws.table(stars.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).withColumn("copies", F.ceil(F.col("rows") / PIVOT_ROWS).cast("int")), "star-counts")
    dealt = join_by_share(stars, counts, "a", "rows", stars.count()).withColumn("deal", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    centres = nodes.join(counts, nodes["rid"] == counts["a"]).select("a", F.col("packed").alias("set_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("deal"))
    dealt = dealt.join(nodes.select(F.col("rid").alias("b"), F.col("packed").alias("set_b")), "b").join(centres, ["a", "deal"])
    links = ws.table(links.unionByName(checked(dealt, percent)), "star-links")
    ws.drop("stars", "star-counts", "pivots", "long-sets")
    roots = components(ws, links, "stars")

    # what the stars leave apart
    placed = ws.table(posts.select("h", "rid", "n").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "placed")
    mains = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("volume")).groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.max(F.struct("k", "root", "volume"))["volume"].alias("main_volume"), F.sum("k").alias("rows"), F.sum("volume").alias("volume"))
    mains = mains.join(lists.select("h"), "h").filter("roots > 1").select("h", "main", "rows", F.ceil((F.col("volume") - F.col("main_volume")) / BLOCK_SHINGLES).cast("int").alias("odd"), F.ceil(F.col("volume") / BLOCK_SHINGLES).cast("int").alias("all"))
    mains = ws.table(mains, "mains")
    if mains.isEmpty():
        return roots, None
    left = join_by_share(placed, mains, "h", "rows", total).filter("main IS NOT NULL")
    at = F.xxhash64("rid")
    odd = left.filter("root <> main").select("h", "rid", "root", F.pmod(at, F.col("odd")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(0).alias("side"))
    every = left.select("h", "rid", "root", F.explode(F.sequence(F.lit(0), F.col("odd") - 1)).alias("i"), F.pmod(at, F.col("all")).cast("int").alias("j"), F.lit(1).alias("side"))
    work = odd.unionByName(every).join(sets, "rid").select("h", "i", "j", "side", "rid", "root", "packed")
    work = work.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side")

    def meet(batches):
        rows = (r for b in slices(batches, 6) for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, block in groupby(rows, key=lambda r: r[:3]):  # two blocks of about BLOCK_SHINGLES
            block = list(block)
            arrays, side = [unpacked(r[6]) for r in block], np.array([r[3] for r in block])
            out = [(block[x][4], block[y][4]) for x, y in _joining(arrays, np.flatnonzero(side == 0), np.flatnonzero(side == 1), percent, [r[5] for r in block])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return links, ws.table(work.mapInArrow(meet, "a long, b long"), "rest-links")


def _joining(arrays: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, roots: list | None = None) -> list[tuple[int, int]]:
    """Of the similar pairs of left x right, those that join two components, as they come; roots: components known before."""
    size = np.array([len(a) for a in arrays])
    flat = np.concatenate(arrays)
    row = np.repeat(np.arange(len(arrays)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    to_left, to_right = np.full(len(arrays), -1), np.full(len(arrays), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    start = 0
    while start < len(column):  # some columns at a time
        end = int(np.searchsorted(column, column[start] + COLUMNS))
        c, r = column[start:end] - column[start], row[start:end]
        x, y = (np.zeros((len(side), COLUMNS), np.float32) for side in (left, right))
        for matrix, to in ((x, to_left), (y, to_right)):
            inside = to[r] >= 0
            matrix[to[r][inside], c[inside]] = 1
        shared += x @ y.T
        start = end
    union = size[left][:, None] + size[right][None] - shared
    first: dict = {}
    root = [i if roots is None else first.setdefault(roots[i], i) for i in range(len(arrays))]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(100 * shared >= percent * union)):
        a, b = int(left[x]), int(right[y])
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            out.append((a, b))
    return out


def one_of_each(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, that stand for their component.

    Rows are told apart by what they hold (hashes of the text and of all columns,
    192 bits), never by their place, so it doesn't matter how often and with
    how many tasks docs is read. The row with the smallest hashes stays; of rows
    equal in all columns one stays. Null ids are values like others. Rows with
    null or blank texts all stay.
    """
    ws, key = Workspace(spark, "kept"), "_row"
    while key in docs.columns:
        key += "_"
    plain = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.concat(F.unhex(F.md5(text.cast("binary"))), F.unhex(F.lpad(F.hex(F.xxhash64(*plain)), 16, "0")))
    labelled = _labelled(ws, docs.select(hashes.alias("key"), text.alias("text")), words, percent).filter("n > 0")
    flags = ws.table(labelled.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("key") == F.col("root")).alias("stays")).filter("k > 1 OR NOT stays").select(F.col("key").alias(key), "stays"), "flags")
    gone, repeated = flags.filter("NOT stays").select(key), flags.filter("stays").select(key)
    docs = docs.withColumn(key, hashes).join(if_small(gone, 24), key, "left_anti")
    if not repeated.isEmpty():
        one = docs.join(if_small(repeated, 24), key, "left_semi").dropDuplicates([key])
        docs = docs.join(if_small(repeated, 24), key, "left_anti").unionByName(one)
    return docs.drop(key)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similar_components of all documents: every row's number of shingles and component. Nulls, blanks, repeats and empty tables as there."""
    return similar_components(spark, read(spark, sf_dir, "documents"))
