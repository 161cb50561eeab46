"""Benchmark decontamination by latent semantic retrieval.

1. Texts become rows of word ids, those of the benchmark's vocabulary (other words
   occur in no item and are -1). The rows are written once; document
   frequencies of all words come from the same pass over all documents.
2. All passages of all documents (PASSAGE words each) and those of the items are the
   rows of a TF-IDF matrix A, the items' weighted so that they count ITEM_WEIGHT
   times as much as the corpus. Each partition adds its rows' share to the
   sketch A'(A W) with random W; the truncated SVD of A comes from the sketch alone
   (Nystrom's method, as A'A is positive semidefinite). There is one space for
   all items.
3. Overlapping passages are searched for items by cosine in that space.
4. Candidates are verified, exactly. First by the number of an item's places
   whose word occurs nearby; then by the longest common subsequence (LCS) of
   words, which must cover NEAR_COPY of the item, or PARAPHRASE of it with its
   answer (what follows ``answer:``, if it states one) there too; in a paraphrase the
   covered share and the share of the item's IDF weight there make up EVIDENCE
   together, as common words alone come in order by chance.

Bounds: PART_ITEMS items share a vocabulary, a space and so a pass of steps 1 and
2; larger benchmarks come in parts. BLOCK_ITEMS items are searched for in a pass of
step 3 over the written rows; what a block finds doesn't depend on other blocks.
FEATURES bounds the rows of the sketch: words beyond share them by number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.llm.common import Workspace, if_small, map_sum, read, slices

PART_ITEMS, BLOCK_ITEMS = 65_536, 512
FEATURES = 1 << 17
PASSAGE, STRIDE = 64, 32
ITEM_PASSAGE = 48  # words of an item that are searched for at once; a bit each
RANK, OVERSAMPLE = 96, 8
ITEM_WEIGHT = 3.0
COSINE = 0.28
NEAR_COPY, PARAPHRASE, EVIDENCE = 0.75, 0.5, 0.72
ROW_WORDS = 65_536  # of a longer text in one row
GROUP_WORDS = 1 << 14  # gone through at a time: what belongs to them stays in a core's cache
PAIR_WORDS = 1 << 21  # looked up at a time
SEED = 77

_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"(?i)\banswer\s*:\s*(.+)\Z", re.S)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each element of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """Benchmark items with a vocabulary in common; ``learn`` and ``finish`` give it what the corpus tells."""

    def __init__(self, texts: list[str]):
        words = [words_of(t) for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.ids = [[self.vocabulary[w] for w in ws] for ws in words]
        answers = (words_of(m[1]) if (m := _ANSWER.search(t or "")) else [] for t in texts)
        self.answers = [{self.vocabulary[w] for w in a if w in self.vocabulary} for a in answers]
        self.features = min(len(self.vocabulary), FEATURES)
        self.longest = max(map(len, self.ids), default=0)

    def row(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))

    def parts(self, items: range) -> list[tuple[int, int, np.ndarray]]:
        """(item, first word, word ids) of the items' passages."""
        return [(k, i, np.array(self.ids[k][i : i + ITEM_PASSAGE], np.int32)) for k in items for i in range(0, max(len(self.ids[k]) - ITEM_PASSAGE // 2, 1), ITEM_PASSAGE) if self.ids[k]]

    def learn(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((n_docs + 1) / (df + 0.5)).astype(np.float32)
        self.idf = np.maximum(self.idf, 1e-3)

    def sketch(self, flat: np.ndarray, ends: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
        """Adds rows' (rows table) to out, for the rows of unit weight whose word ids end in flat at ends; none is empty."""
        if not len(ends):
            return
        first, idf, feature = np.r_[0, ends[:-1]], self.idf[flat], flat % self.features
        n = np.diff(np.r_[0, ends])
        scale = 1 / np.sqrt(np.add.reduceat(idf.astype(np.float64) ** 2, first))
        own = table[feature]
        own *= idf[:, None]
        y = np.add.reduceat(own, first) * (scale**2)[:, None].astype(np.float32)
        order = np.argsort(feature, kind="stable")
        part = y[np.repeat(np.arange(len(n)), n)[order]]
        part *= idf[order][:, None]
        start = np.flatnonzero(np.r_[True, np.diff(feature[order]) > 0])
        out[feature[order][start]] += np.add.reduceat(part, start)

    def table(self) -> np.ndarray:
        return np.random.default_rng(SEED).normal(size=(self.features, min(RANK + OVERSAMPLE, self.features))).astype(np.float32)

    def finish(self, sketch: np.ndarray) -> None:
        """Right singular vectors of A from its sketch and the items'."""
        w = self.table().astype(np.float64)
        own = np.zeros_like(sketch)
        parts = [p for *_, p in self.parts(range(len(self.ids)))]
        if parts:
            self.sketch(np.concatenate(parts), np.cumsum([len(p) for p in parts]), self.table(), own)
        y = sketch + ITEM_WEIGHT * max(1.0, np.linalg.norm(sketch) / max(np.linalg.norm(own), 1e-12)) * own
        core = w.T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        keep = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
        half = y @ (vectors[:, keep] / np.sqrt(values[keep]))
        u, s, _ = np.linalg.svd(half, full_matrices=False)
        self.latent = u[:, : min(RANK, int((s > 1e-9 * s.max(initial=1e-300)).sum()))].astype(np.float32)

    def block(self, items: range) -> "Block":
        parts = self.parts(items)
        used = np.unique(np.concatenate([p for *_, p in parts])) if parts else np.empty(0, np.int64)
        local = np.zeros(len(self.vocabulary) + 1, np.int32)  # 0: no word of the block; the last: no word of any item
        local[used] = np.arange(1, len(used) + 1)
        masks = np.zeros((len(parts), len(used) + 1), np.uint64)
        for j, (_, _, p) in enumerate(parts):
            np.bitwise_or.at(masks[j], local[p], np.uint64(1) << np.arange(len(p), dtype=np.uint64))
        vectors = np.stack([self.idf[p] @ self.latent[p % self.features] for *_, p in parts]) if parts else np.empty((0, self.latent.shape[1]))
        numbers = {k: n for n, k in enumerate(items)}
        return Block(
            first=items.start, ids=[self.ids[k] for k in items], answers=[self.answers[k] for k in items], idf=self.idf, latent=self.latent, features=self.features,
            item=np.array([numbers[k] for k, *_ in parts], np.int64), offset=np.array([i for _, i, _ in parts], np.int64), masks=masks, local=local,
            least=np.array([math.ceil(PARAPHRASE * len(p)) for *_, p in parts]), targets=_unit(vectors).astype(np.float32),
        )


@dataclass
class Block:
    """What is needed to search for a block of items."""

    first: int
    ids: list[list[int]]
    answers: list[set[int]]
    idf: np.ndarray
    latent: np.ndarray
    features: int
    item: np.ndarray  # of each item passage
    offset: np.ndarray
    masks: np.ndarray  # of each item passage and word: places of the word
    local: np.ndarray
    least: np.ndarray
    targets: np.ndarray

    def search(self, rows: list[np.ndarray]):
        """(row, item number, cosine, LCS share) of the hits in rows of word ids; an item may come up several times."""
        if not len(self.item) or not rows:
            return
        if not hasattr(self, "table"):
            self.table = self.latent[np.arange(len(self.idf)) % self.features] * self.idf[:, None]
        table = self.table
        size = np.array([len(r) for r in rows])
        base = np.cumsum(size) - size
        flat = np.concatenate(rows)
        halves = np.maximum(1, -(-size // STRIDE))
        half_base = np.cumsum(halves) - halves
        owner = np.repeat(np.arange(len(rows)), size)
        known = np.flatnonzero(flat >= 0)
        words = flat[known]
        half = half_base[owner[known]] + (known - base[owner[known]]) // STRIDE
        z = np.zeros((int(halves.sum()), table.shape[1]), np.float32)
        start = np.flatnonzero(np.r_[True, np.diff(half) > 0]) if len(half) else half
        if len(start):
            z[half[start]] = np.add.reduceat(table[words], start)
        number = np.arange(len(z)) - np.repeat(half_base, halves)
        last = number == np.repeat(halves, halves) - 1
        z[:-1] += np.where(last[:-1, None], 0, z[1:])  # a passage is two halves
        passage = np.flatnonzero(~last | (number == 0))
        cosine = _unit(z[passage]) @ self.targets.T
        at, j = np.nonzero(cosine >= COSINE)
        if not len(at):
            return
        row = np.repeat(np.arange(len(rows)), halves)[passage[at]]
        begin = number[passage[at]] * STRIDE  # of the passage in its row
        # places whose word occurs in the passage or STRIDE words around it
        low = np.searchsorted(known, base[row] + np.maximum(begin - STRIDE, 0))
        high = np.searchsorted(known, base[row] + np.minimum(begin + PASSAGE + STRIDE, size[row]))
        width, local = self.masks.shape[1], self.local[words]
        good, ends = [], np.cumsum(high - low)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PAIR_WORDS)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            n = (high - low)[a:b]
            full = np.flatnonzero(n) + a
            n = n[n > 0]
            if len(full):
                places = np.repeat(low[full] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                seen = np.bitwise_or.reduceat(self.masks.ravel()[np.repeat(j[full] * width, n) + local[places]], np.cumsum(n) - n)
                good += full[np.bitwise_count(seen) >= self.least[j[full]]].tolist()
        for i in good:
            k, r = int(self.item[j[i]]), int(row[i])
            n, offset = len(self.ids[k]), int(self.offset[j[i]])
            region = rows[r][max(0, int(begin[i]) - offset - STRIDE) : int(begin[i]) + PASSAGE + n - offset + STRIDE]
            share = self.verified(k, region.tolist())
            if share:
                yield r, self.first + k, float(cosine[at[i], j[i]]), share

    def verified(self, k: int, region: list[int]) -> float:
        """Share of item k in its longest common subsequence with region, or 0 if that is no hit."""
        ids, n = self.ids[k], len(self.ids[k])
        own = set(ids)
        common = own.intersection(region)
        answered = self.answers[k] <= common
        bound = sum([i in common for i in ids])  # no subsequence is longer
        if bound < (PARAPHRASE if answered else NEAR_COPY) * n:
            return 0.0
        weight = float(self.idf[list(common)].sum() / self.idf[list(own)].sum())
        least = min(NEAR_COPY, max(PARAPHRASE, EVIDENCE - weight)) if answered else NEAR_COPY
        share = lcs(ids, region) / n if bound >= least * n else 0.0
        return share if share >= least - 1e-9 else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def tokenised(ws: Workspace, items: Items, docs: DataFrame, name: str) -> tuple[DataFrame, np.ndarray, int]:
    """(key, skip, ids: 4 bytes a word) of docs (key, text) as a written table, and from the same pass how many documents hold each word, and their number.

    A longer text has several rows that overlap by ``skip`` words.
    """
    size, overlap = len(items.vocabulary), items.longest + 4 * PASSAGE
    held = docs.sparkSession.sparkContext.broadcast(items)
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches):
        items, total = held.value, np.zeros(size + 1)
        kind = None
        for b in slices(batches, 1):
            kind = b.column(0).type
            at, skip, rows = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                row = items.row(words_of(t))
                seen = np.unique(row)
                total[seen[seen >= 0]] += 1
                for start in range(0, max(len(row), 1), ROW_WORDS):
                    at.append(i)
                    skip.append(min(start, overlap))
                    rows.append(row[max(0, start - overlap) : start + ROW_WORDS])
            total[size] += b.num_rows
            data = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(skip, pa.int32()), data, pa.nulls(len(rows), pa.binary())], names=["key", "skip", "ids", "counts"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["key", "skip", "ids", "counts"])

    table = ws.table(docs.select("key", "text").mapInArrow(run, f"key {key_type}, skip int, ids binary, counts binary"), name)

    def add(b, total):
        for v in b.column(0):
            total += np.frombuffer(v.as_buffer())

    counts = map_sum(table.filter("counts IS NOT NULL").select("counts"), add, (size + 1,))
    return table.filter("counts IS NULL").drop("counts"), counts[:size], int(counts[size])


def _rows(b: pa.RecordBatch, at: int):
    """Numbers of rows and their word ids in groups of about GROUP_WORDS words."""
    numbers, group, words = [], [], 0
    for i, v in enumerate(b.column(at)):
        numbers.append(i)
        group.append(np.frombuffer(v.as_buffer(), np.int32))
        words += len(group[-1])
        if words >= GROUP_WORDS:
            yield numbers, group
            numbers, group, words = [], [], 0
    if group:
        yield numbers, group


def learn(ws: Workspace, items: Items, docs: DataFrame, name: str) -> DataFrame:
    """Learns frequencies and the latent space from all of docs (key, text); returns their rows (key, ids)."""
    rows, df, n_docs = tokenised(ws, items, docs, name)
    items.learn(df, n_docs)
    held = docs.sparkSession.sparkContext.broadcast(items)
    shape = items.table().shape

    def add(b, total):
        items, table = held.value, held.value.table()
        skips = np.asarray(b.column(0))
        for numbers, group in _rows(b, 1):
            flat, passage, last = [], [], 0
            for i, row in zip(numbers, group):
                row = row[skips[i] :]
                at = np.flatnonzero(row >= 0)
                flat.append(row[at])
                passage.append(last + at // PASSAGE)
                last += len(row) // PASSAGE + 1
            flat, passage = np.concatenate(flat), np.concatenate(passage)
            items.sketch(flat, np.flatnonzero(np.r_[np.diff(passage) > 0, True]) + 1 if len(flat) else flat, table, total)

    items.finish(map_sum(rows.select("skip", "ids"), add, shape))
    return rows.select("key", "ids")


def parts_of(benchmark: DataFrame):
    """(item ids, Items) of the benchmark in parts of PART_ITEMS, by id and text; null and wordless texts ask nothing, repeats ask once."""
    asked = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct().orderBy("item_id", "text")
    names: list = []
    texts: list[str] = []
    for r in asked.toLocalIterator():
        if words_of(r.text):
            names.append(r.item_id)
            texts.append(r.text)
        if len(texts) == PART_ITEMS:
            yield names, Items(texts)
            names, texts = [], []
    if texts:
        yield names, Items(texts)


def hits(ws: Workspace, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, cosine, lcs) of every hit in docs (key, text)."""
    spark, key = docs.sparkSession, docs.schema["key"]
    found = StructType([key, *spark.createDataFrame([], "item int, cosine double, lcs double").schema.fields])
    name_of = benchmark.schema["item_id"]
    out = spark.createDataFrame([], StructType([key, name_of, *found.fields[2:]]))
    for number, (names, items) in enumerate(parts_of(benchmark)):
        rows = learn(ws, items, docs, f"rows-{number}")
        for first in range(0, len(names), BLOCK_ITEMS):
            held = spark.sparkContext.broadcast(items.block(range(first, min(first + BLOCK_ITEMS, len(names)))))

            def run(batches, held=held):
                block = held.value
                for b in batches:
                    got = [(numbers[r], k, c, s) for numbers, group in _rows(b, 1) for r, k, c, s in block.search(group)]
                    columns = [list(c) for c in zip(*got)] or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=["key", "item", "cosine", "lcs"])

            known = spark.createDataFrame([(i, names[i]) for i in range(first, min(first + BLOCK_ITEMS, len(names)))], StructType([StructField("item", IntegerType()), name_of]))
            out = out.unionByName(rows.mapInArrow(run, found).join(F.broadcast(known), "item").select("key", "item_id", "cosine", "lcs"))  # BLOCK_ITEMS rows
    return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): which documents hold which benchmark items.

    docs has doc_id and text; a pair occurs once, with its best passage, also if
    ids repeat. Null and empty texts hold nothing, null ids are kept. Other
    columns are not looked at. Without items or documents the result is empty.
    """
    docs = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    found = hits(Workspace(spark, "decontamination"), docs, benchmark)
    return found.groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item.

    Rows are told apart by their text alone, so repeated rows, null ids and other
    columns don't matter; null and empty texts stay.
    """
    ws, key = Workspace(spark, "decontamination"), "_text"
    while key in docs.columns:
        key += "_"
    name = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    found = hits(ws, docs.select(name.alias("key"), F.col("text").cast("string").alias("text")), benchmark)
    gone = ws.table(found.select(F.col("key").alias(key)).distinct(), "gone")
    return docs.withColumn(key, name).join(if_small(gone, 16), key, "left_anti").drop(key)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contaminated, of all documents and all benchmark items. Nulls, empty texts, repeats and empty tables as there."""
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
