"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are standardised by their mean and deviation over
all documents. Random Fourier features approximate a Gaussian kernel over them.
The normal equations are summed within each partition and then over a tree of
tasks; they are kept by fold, so that models without a fold come from one pass.
Scores of each fold by the model without it are calibrated by pool adjacent
violators, over counts in fixed bins of the score. All that reaches the driver
has a size set by the parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from docloom.llm.common import Workspace, crc_mod, map_sum, read, slices

N_RANDOM = 256
FOLDS = 4
RIDGES = (1e-3, 1e-2, 1e-1)  # of the number of rows
BINS = 2048
LOW, HIGH = -0.5, 1.5
SEED = 20240229
CLIP = 6.0

NAMES = ("chars", "words", "word_chars", "letters", "upper", "digits", "spaces", "marks", "symbols", "other_bytes", "bars", "bangs", "distinct", "top_word", "repeats", "short_words", "lines", "line_chars", "copied_lines")
D = len(NAMES)

_GROUPS = {
    "letters": [*range(65, 91), *range(97, 123)],
    "upper": range(65, 91),
    "digits": range(48, 58),
    "spaces": (9, 10, 13, 32),
    "marks": b".,;:'\"()-",
    "symbols": b"#$%&*+/<=>@\\^_`~{}[]",
    "bars": b"|",
    "bangs": b"!?",
}
_MASK = {k: np.isin(np.arange(256), list(v)).astype(np.float64) for k, v in _GROUPS.items()}
_MASK["other_bytes"] = (np.arange(256) > 127).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """NAMES of a text; an empty or null one has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * D
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words = data.split()
    n = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    value = {
        "chars": math.log1p(len(data)),
        "words": math.log1p(len(words)),
        "word_chars": sum(map(len, words)) / n,
        **{k: float(share @ m) for k, m in _MASK.items()},
        "distinct": math.log1p(len(counts)) / math.log1p(n),
        "top_word": max(counts.values(), default=0) / n,
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / n,
        "short_words": sum(c for w, c in counts.items() if len(w) <= 3) / n,
        "lines": math.log1p(len(lines)),
        "line_chars": math.log1p(len(data) / len(lines)),
        "copied_lines": 1 - len(set(lines)) / len(lines),
    }
    return [value[k] for k in NAMES]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray  # D x N_RANDOM
    phases: np.ndarray
    weights: np.ndarray  # N_RANDOM + 1
    levels: tuple[np.ndarray, np.ndarray]  # of raw scores, and calibrated

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)
        return np.hstack((math.sqrt(2 / N_RANDOM) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, *self.levels) if len(x) else np.empty(0)


def pool_adjacent_violators(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit of y."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w2) / (u[1] + w2), u[1] + w2, u[2] + n]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of (doc_id, text)."""

    def run(batches):
        for b in slices(batches, 1):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, D)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, stats: DataFrame, ws: Workspace) -> Model:
    """Learns from the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    rng = np.random.default_rng(SEED)
    at = [F.col("x")[i] for i in range(D)]
    moments = stats.agg(*(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    mean = np.array([m or 0.0 for m in moments[:D]])
    deviation = np.array([m if m and m > 1e-9 else 1.0 for m in moments[D:]])
    blank = Model(mean, deviation, rng.normal(0, math.sqrt(2 / D), (D, N_RANDOM)), rng.uniform(0, 2 * math.pi, N_RANDOM), np.zeros(N_RANDOM + 1), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = ws.table(stats.filter(crc_mod(F.col("doc_id"), 3) != 1).join(known, "doc_id").select(fold.alias("fold"), "x", "y"), "train")
    size = N_RANDOM + 2  # features, constant, label

    def products(b, total):
        z = np.hstack((blank.features(_matrix(b.column(1))), np.asarray(b.column(2))[:, None]))
        folds = np.asarray(b.column(0))
        for f in range(FOLDS):
            own = z[folds == f]
            total[f] += own.T @ own

    sums = map_sum(train, products, (FOLDS, size, size))
    whole = sums.sum(axis=0)
    n = whole[-2, -2]
    if not n:  # nothing to learn from: every document is as good as any
        return Model(blank.mean, blank.deviation, blank.frequencies, blank.phases, blank.weights, (np.array([0.0, 1.0]), np.array([1.0, 1.0])))

    def solved(m: np.ndarray, ridge: float) -> np.ndarray:
        a = m[:-1, :-1] + ridge * max(m[-2, -2], 1) * np.eye(size - 1)
        a[-1, -1] = m[-2, -2] + 1e-9  # the constant is free
        return np.linalg.solve(a, m[:-1, -1])

    def error(w: np.ndarray, m: np.ndarray) -> float:
        return float(m[-1, -1] - 2 * w @ m[:-1, -1] + w @ m[:-1, :-1] @ w)

    ridge = min(RIDGES, key=lambda r: sum(error(solved(whole - sums[f], r), sums[f]) for f in range(FOLDS)))
    without = np.stack([solved(whole - sums[f], ridge) for f in range(FOLDS)])

    def binned(b, counts):
        raw = np.einsum("ij,ij->i", blank.features(_matrix(b.column(1))), without[np.asarray(b.column(0))])
        bins = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        counts += np.stack((np.bincount(bins, minlength=BINS), np.bincount(bins, np.asarray(b.column(2)), BINS)), axis=1)

    counts = map_sum(train, binned, (BINS, 2))
    used = np.flatnonzero(counts[:, 0])
    level = pool_adjacent_violators(counts[used, 1] / counts[used, 0], counts[used, 0])
    # one point for each level, at its mean score; straight lines between keep the order of scores
    centre, first = LOW + (used + 0.5) * (HIGH - LOW) / BINS, np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
    weight = np.add.reduceat(counts[used, 0], first)
    points = np.add.reduceat(counts[used, 0] * centre, first) / weight
    raw = np.r_[LOW - 1, points, HIGH + 1]
    good = float(level @ counts[used, 0]) / n
    ends = (level[0] * weight[0] + good * 0.5) / (weight[0] + 1) * 0.5, 1 - (1 - (level[-1] * weight[-1] + good) / (weight[-1] + 1)) * 0.5
    calibrated = np.maximum.accumulate(np.r_[min(ends[0], level[0] + 1e-6), level[first], max(ends[1], level[-1])])
    return Model(blank.mean, blank.deviation, blank.frequencies, blank.phases, solved(whole, ridge), (raw, np.clip(calibrated, 0, 1)))


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, ws: Workspace) -> tuple[Model, DataFrame]:
    """The model, and the statistics of all documents as a table."""
    stats = ws.table(text_statistics(docs), "statistics")
    return fit(spark, docs, labels, stats, ws), stats


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Null texts count as empty and have a score like any other text. Rows with
    null ids are scored and not held out; labels with null ids or null quality
    teach nothing; of several labels of a document the mean counts. Without any
    label to learn from all scores are 1. Labels, lang, source and ids are no
    inputs. Other columns are not looked at. An empty table gives an empty result.
    """
    ws = Workspace(spark, "quality")
    model, stats = learned(spark, docs.select("doc_id", "text"), labels, ws)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b.column(1))))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, StructType([stats.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose score is at least 0.5. Rows with nulls are scored like others (see score_quality)."""
    model, _ = learned(spark, docs.select("doc_id", "text"), labels, Workspace(spark, "quality"))
    at = docs.columns.index("text")
    flag = "_good"
    while flag in docs.columns:
        flag += "_"

    def run(batches):
        for b in slices(batches, at):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x) >= 0.5)], names=[*b.schema.names, flag])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(flag, BooleanType())])).filter(F.col(flag)).drop(flag)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality of all documents. Nulls, empty texts, repeats and empty tables as there."""
    return score_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
