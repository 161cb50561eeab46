"""Language-model scores of documents, beside those of smoothed word counts.

1. Each text is cut into words and subword ids once, and its ids are kept beside it;
   in the same pass the words of all training documents are counted (partial counts
   in each task).
2. The ids of training documents are counted. They lay out the model's output tree.
3. A causal self-attention model (``attention``) takes its first steps in one task
   on a bounded sample, SAMPLE_DOCS documents and SAMPLE_IDS ids at most. Then all
   partitions train on all of their own training documents, each document, whole, in
   one of ROUNDS rounds, and the weights are averaged by the number of ids seen
   after each round.
4. Every text is scored in overlapping windows; each id is scored once. In the
   same pass the HEAD_WORDS most frequent words give their share of the base
   score; less frequent words are joined with their counts by a shuffle.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import attention
from docloom.llm.common import Numbers, Workspace, crc_mod, grown, keep_memory, map_sum, read, slices, summed
from docloom.llm.pieces import MODEL_PATH, model_bytes

SMOOTHING = 0.1
HEAD_WORDS = 200_000
#: Bounds of the sample that the first steps are taken on; small samples are read again, SAMPLE_READS times at most.
SAMPLE_DOCS, SAMPLE_IDS, SAMPLE_READS = 2000, 2_000_000, 4
ROUNDS = 2
LEARNING_RATE, AVERAGED_RATES = 0.02, (0.012, 0.004)
#: Windows in a step of the first training and of the averaged rounds.
TRAIN_WINDOWS, AVERAGED_WINDOWS = 192, 256
SEGMENT_IDS = 65_536
GROUP_IDS = 16_384  # scored at a time: their rows of scores stay in a core's cache
CACHE_WORDS = 300_000
CONTEXT = attention.WINDOW - attention.STRIDE
END = b""  # stands for a text's end among the words


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """A table of words with their ids and counts; a text's end is an id of its own."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size, self.end = self.sp.get_piece_size(), self.sp.eos_id()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<i4")  # of kept ids
        self.clear()

    def clear(self) -> None:
        self.place = Numbers()
        self.words: list[bytes] = []
        self.flat, self.start, self.counts = np.empty(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.place[END], self.place.fresh = 0, []
        self._add([END])

    def _add(self, words: list[bytes]) -> None:
        pieces = self.sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        ids = [[self.end] if w == END else x or [self.sp.unk_id()] for w, x in zip(words, pieces)]
        first, n = len(self.words), len(words)
        ends = self.start[first] + np.cumsum([len(x) for x in ids])
        self.flat, self.start, self.counts = (grown(a, size) for a, size in ((self.flat, int(ends[-1])), (self.start, first + n + 1), (self.counts, first + n)))
        self.flat[self.start[first] : ends[-1]] = np.fromiter(chain.from_iterable(ids), self.kind, int(ends[-1] - self.start[first]))
        self.start[first + 1 : first + n + 1] = ends
        self.words += words

    def places(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers in the table of each text's words and its end."""
        found = [np.array([*map(self.place.__getitem__, words), 0], np.int64) for words in texts]
        if self.place.fresh:
            self._add(self.place.fresh)
            self.place.fresh = []
        return found

    def count(self, places: np.ndarray) -> None:
        self.counts[: len(self.words)] += np.bincount(places, minlength=len(self.words))

    def counted(self) -> tuple[list[bytes], np.ndarray]:
        at = np.flatnonzero(self.counts[: len(self.words)])
        return [self.words[i] for i in at.tolist()], self.counts[at]

    def ids(self, places: np.ndarray) -> np.ndarray:
        first, n = self.start[places], self.start[places + 1] - self.start[places]
        return self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def kept(self, column) -> list[np.ndarray]:
        """Ids of texts as ``cut`` keeps them."""
        return [np.frombuffer(x, self.kind) for x in column.to_pylist()]


def segments(ids: np.ndarray):
    """(ids, places not to score) of a sequence in bounded pieces; later ones begin with some context."""
    yield ids[:SEGMENT_IDS], 0
    for start in range(SEGMENT_IDS, len(ids), SEGMENT_IDS):
        yield ids[start - CONTEXT : start + SEGMENT_IDS], CONTEXT


def cut(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (doc_id, held_out, text) with ``pieces``, the bytes of each text's ids; then rows of ``word`` and ``c`` alone, partial counts of the words and ends of texts that aren't held out."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        s, types = Subwords(held.value), []

        def counts():
            words, c = s.counted()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(c), t) for t in types), pa.nulls(len(c), pa.binary()), pa.array(words, pa.binary()), pa.array(c)], names=names)

        for b in slices(batches, 2):
            if len(s.words) > CACHE_WORDS:
                yield from counts()
                s.clear()
            types = [c.type for c in b.columns]
            places = s.places([words_of(t) for t in b.column(2).to_pylist()])
            teaching = [p for p, out in zip(places, b.column(1).to_pylist()) if not out]
            if teaching:
                s.count(np.concatenate(teaching))
            pieces = pa.array([s.ids(p).tobytes() for p in places], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pieces, pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.int64())], names=names)
        if types:
            yield from counts()

    names = ["doc_id", "held_out", "text", "pieces", "word", "c"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*names[:3]).mapInArrow(run, f"doc_id {id_type}, held_out boolean, text string, pieces binary, word binary, c long")


def with_pieces(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (doc_id, text), which may be cut already."""
    return docs if "pieces" in docs.columns else cut(docs.withColumn("held_out", F.lit(True)), model).filter("word IS NULL")


def count_ids(docs: DataFrame, model: bytes) -> np.ndarray:
    s = Subwords(model)
    size, kind = s.size, s.kind

    def add(b, total):
        for x in b.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)

    return map_sum(docs.select("pieces"), add, (size,))


def _epoch(model: attention.Attention, optimiser: attention.Adam, data, rate, size: int = TRAIN_WINDOWS) -> None:
    x, y, scored = data
    for i in range(0, len(x), size):
        part = slice(i, i + size)
        if scored[part].any():
            optimiser.step(model.gradient(x[part], y[part], scored[part])[0], rate(i / len(x)))


def train_on_sample(docs: DataFrame, layout: attention.Layout, model: bytes, seed: int) -> np.ndarray:
    """First weights, from documents chosen by hash."""
    total = docs.count()
    part = 1 << 20
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) < math.ceil(part * min(1.0, SAMPLE_DOCS / max(total, 1))))
    held = docs.sparkSession.sparkContext.broadcast((model, layout))

    def train(batches):
        keep_memory()
        piece_model, layout = held.value
        s, net = Subwords(piece_model), attention.Attention(layout.blank(), layout)
        rng, texts, size = np.random.default_rng(seed), [], 0
        for b in slices(batches):
            for ids in s.kept(b.column(0)):
                if size < SAMPLE_IDS:
                    texts.append(ids[: SAMPLE_IDS - size])
                    size += len(texts[-1])
        if texts:
            x, y, scored, _ = attention.windows(texts, layout.leaf, s.end, attention.WINDOW)
            epochs = max(1, min(SAMPLE_READS, math.ceil(SAMPLE_IDS / max(1, size))))
            steps = attention.Adam(net)
            for e in range(epochs):
                order = rng.permutation(len(x))
                _epoch(net, steps, (x[order], y[order], scored[order]), lambda at, e=e: LEARNING_RATE * min(1, 0.02 + 20 * (at + e) / epochs) * (1 - 0.8 * (at + e) / epochs))
        yield pa.RecordBatch.from_arrays([pa.array([net.state.astype(np.float64).tobytes()], pa.binary())], names=["m"])

    state = summed(with_pieces(chosen, model).select("pieces").coalesce(1).mapInArrow(train, "m binary"), layout.blank().shape)
    return state.astype(np.float32)


def turn_of() -> Column:
    """The round that a document (doc_id, text) teaches in."""
    return F.pmod(F.crc32(F.concat_ws(":", F.lit("turn"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).cast("binary")), F.lit(ROUNDS))


def train_everywhere(docs: DataFrame, state: np.ndarray, layout: attention.Layout, model: bytes, turn: int) -> np.ndarray:
    """One round on every partition's own documents of that turn; the weighted mean of the weights."""
    held = docs.sparkSession.sparkContext.broadcast((model, layout, state))

    def train(batches):
        keep_memory()
        piece_model, layout, state = held.value
        s, net = Subwords(piece_model), attention.Attention(state, layout)
        steps, seen, size = attention.Adam(net), 0, 0
        group: list[np.ndarray] = []

        def learn():
            nonlocal seen, size
            if group:
                x, y, scored, _ = attention.windows(group, layout.leaf, s.end, attention.WINDOW)
                seen += int(scored.sum())
                _epoch(net, steps, (x, y, scored), lambda at: AVERAGED_RATES[turn] * min(1, 0.1 + steps.t / 50), AVERAGED_WINDOWS)
            group.clear()
            size = 0

        for b in slices(batches):
            for ids in s.kept(b.column(0)):
                for i in range(0, len(ids), SEGMENT_IDS):
                    group.append(ids[i : i + SEGMENT_IDS])
                    size += len(group[-1])
                    if size >= SEGMENT_IDS:
                        learn()
        learn()
        yield pa.RecordBatch.from_arrays([pa.array([np.append(net.state.astype(np.float64) * seen, seen).tobytes()], pa.binary())], names=["m"])

    total = summed(with_pieces(docs.filter(turn_of() == turn), model).select("pieces").mapInArrow(train, "m binary"), (len(state) + 1,))
    return (total[:-1] / total[-1]).astype(np.float32) if total[-1] else state


def frequent(words: DataFrame) -> list:
    """The most frequent words, HEAD_WORDS at most: those above a level of their counts."""
    level = F.floor(F.log2("c") * 8).cast("int")
    per_level = sorted(((r.level, r.n) for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, least = 0, None
    for at, n in per_level:  # a few hundred levels
        held += n
        if held > HEAD_WORDS:
            break
        least = at
    return [] if least is None else [(bytes(r.word), r.c) for r in words.filter(level >= least).collect()]


def score_texts(spark: SparkSession, docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Null and empty texts hold the end alone. Null ids are not held out. Repeated
    rows are scored one by one, alike, and counted each. Other columns are not
    looked at. Without training documents nothing is known (N and V are 0) and the
    model has its first weights; an empty table gives an empty result.
    """
    ws = Workspace(spark, "scoring")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    cuts = ws.table(cut(docs.withColumn("held_out", held_out), model), "cuts")
    docs = cuts.filter("word IS NULL").drop("word", "c")
    training = docs.filter("NOT held_out")
    words = ws.table(cuts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    denominator = math.log10(n + SMOOTHING * (v + 1))
    layout = attention.Layout(count_ids(training, model))
    state = train_on_sample(training, layout, model, attention.SEED)
    for turn in range(ROUNDS):
        state = train_everywhere(training, state, layout, model, turn)
    head = dict(frequent(words))
    held = spark.sparkContext.broadcast((model, layout, state, {w: math.log10(c + SMOOTHING) - denominator for w, c in head.items()}))

    def run(batches):
        keep_memory()
        piece_model, layout, state, head = held.value
        s, net = Subwords(piece_model), attention.Attention(state, layout)
        key = int.from_bytes(os.urandom(7), "little")
        for b in slices(batches, 2):
            texts = [[*words_of(t), END] for t in b.column(2).to_pylist()]
            lengths = np.array([len(words) for words in texts])
            flat = [*chain.from_iterable(texts)]
            base, owner = np.fromiter(map(head.get, flat, repeat(math.nan)), float, len(flat)), np.repeat(np.arange(len(texts)), lengths)
            rare = np.isnan(base)
            known, total = np.bincount(owner[~rare], minlength=len(texts)), np.bincount(owner[~rare], base[~rare], len(texts))
            pairs = Counter(zip(owner[rare].tolist(), [flat[i] for i in np.flatnonzero(rare).tolist()]))
            tails = pa.StructArray.from_arrays([pa.array([w for _, w in pairs], pa.binary()), pa.array([*pairs.values()], pa.int64())], names=["word", "n"])
            ends = np.searchsorted(np.array([i for i, _ in pairs], np.int64), np.arange(len(texts) + 1))
            scores = _scores(net, s.kept(b.column(3)), s.end)
            keys = np.arange(key, key + len(texts))
            key += len(texts)
            columns = [pa.array(keys), b.column(0), b.column(1), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(total), pa.array(scores / math.log(10)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word:binary,n:long>>"
    rows = ws.table(docs.select("doc_id", "held_out", "text", "pieces").mapInArrow(run, schema), "rows")
    tail = rows.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.n")
    tail = tail.join(words, "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING)) - F.lit(denominator))).alias("tail_base"),
    )
    return rows.drop("tail").join(tail, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _scores(net: attention.Attention, sequences: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log probability of each id sequence."""
    scores = np.zeros(len(sequences))
    group: list[tuple[int, np.ndarray, int]] = []

    def flush():
        if group:
            x, y, scored, row = attention.windows([ids for _, ids, _ in group], net.layout.leaf, start)
            late = np.r_[True, row[1:] != row[:-1]] & (np.array([skip for *_, skip in group])[row] > 0)
            scored[late, :CONTEXT] = False
            owner = np.array([i for i, *_ in group])[np.repeat(row, scored.sum(axis=1))]
            scores[:] += np.bincount(owner, net.log_probs(x, y, scored), len(scores))
        group.clear()

    size = 0
    for i, ids in enumerate(sequences):
        for segment, skip in segments(ids):
            group.append((i, segment, skip))
            size += len(segment)
            if size >= GROUP_IDS:
                flush()
                size = 0
    flush()
    return scores


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts of all documents. Nulls, empty texts, repeats and empty tables as there."""
    return score_texts(spark, read(spark, sf_dir, "documents"), model_bytes(MODEL_PATH))
