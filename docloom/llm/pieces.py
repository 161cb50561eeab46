"""N-best segmentation into SentencePiece pieces, and decoding.

The lattice of a text has an edge for each piece that occurs at a position; a
character of no piece is one edge of its UTF-8 bytes. Forward Viterbi gives each
position the best score of the text before it. Those scores are the exact
heuristic of a backward A* search, which takes the N best paths off a queue in
order.

No piece goes from a character other than a space to a space, nor across a line
end. So the lattice falls apart at these places without loss ("chunks"), and
each distinct chunk is searched once and kept in a bounded cache. The N best of
a text are the N best combinations of its chunks' paths: only the N - 1 chunks
that lose least by their second path can take part, and those are combined best
first. All scores are integers (millionths), so sums are exact and the order of
ties is fixed: fewer losses, then earlier chunks, then the order of A*.

A model that stores merge ranks instead of log probabilities says nothing of the
probability of a path. Its pieces are then scored by Zipf's law, ``-ln(rank + 2)``:
the paths are those of a unigram model over the same pieces, not the merges' own
(the README has how often they agree). The model's normaliser isn't applied and a
literal U+2581 is written in bytes, which makes decoding an exact inverse.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import Numbers, bound_batches, grown, read, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = 1_000_000
NEVER = -(1 << 80)
#: 32-bit scores in arrays: no edge, no path; real paths, of at most ARRAY_CHARS edges, stay above LEAST.
NO_EDGE, NO_PATH, LEAST = -(1 << 30), -(1 << 30) + 1, -(1 << 29)
ARRAY_CHARS = 24
CODE_BITS = 21
N_BEST = 4
#: Chunks in an encoder's table, and of those the ones with known alternatives; longer chunks are not kept.
CACHE_CHUNKS, CACHE_OTHERS = 500_000, 50_000
CACHED_CHARS = 64
SLICE_BYTES = 1 << 20
#: Names the file of the model in a session.
MODEL_SETTING = "spark.docloom.pieces.model"
ALTERNATIVES = "array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"
ENCODED = f"ids array<int>, score double, others {ALTERNATIVES}"
_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


class Pieces:
    """Pieces of a serialized model with integer scores."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        scores = [sp.get_score(i) for i in range(size)]
        ranks = min(scores) < -1000
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        self.edges: dict[str, tuple[int, tuple[int, ...]]] = {}
        lowest = 0
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                score = round(UNIT * (-math.log(2 - scores[i]) if ranks else scores[i]))
                lowest = min(lowest, score)
                shown = piece.replace(SPACE, " ")
                if "\n" in shown[1:] or shown[:-1] and "\n" in shown or " " in shown.lstrip(" "):
                    raise ValueError("pieces cross the places where chunks are cut")
                self.edges[shown] = (score, (i,))
        self.byte_score = lowest - 10 * UNIT
        self.longest = max(map(len, self.edges), default=1)
        self.array_chars = min(ARRAY_CHARS, LEAST // min(lowest, -1) - 1)
        self.score_of = {i: score for score, (i,) in self.edges.values()} | {i: self.byte_score for i in self.byte_ids}
        # the pieces as a trie: a step from a node with a character is a key in a sorted array
        nodes: dict[str, int] = {"": 0}
        for shown in sorted(self.edges):
            for n in range(1, len(shown) + 1):
                nodes.setdefault(shown[:n], len(nodes))
        steps = sorted(((nodes[t[:-1]] << CODE_BITS) | ord(t[-1]), i) for t, i in nodes.items() if t)
        self.step_keys, self.step_nodes = np.array([k for k, _ in steps], np.int64), np.array([i for _, i in steps], np.int32)
        self.node_score, self.node_id = np.full(len(nodes), NO_EDGE, np.int32), np.zeros(len(nodes), np.int32)
        for shown, (score, ids) in self.edges.items():
            self.node_score[nodes[shown]], self.node_id[nodes[shown]] = score, ids[0]

    def _bytes_edge(self, c: str) -> tuple[int, tuple[int, ...]]:
        raw = c.encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)

    def _from(self, text: str, i: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Edges at i: end, score, ids."""
        found = [(j, *self.edges[sub]) for j in range(i + 1, min(len(text), i + self.longest) + 1) if (sub := text[i:j]) in self.edges]
        if not found or found[0][0] != i + 1:
            found.insert(0, (i + 1, *self._bytes_edge(text[i])))
        return found

    def viterbi(self, texts):
        """(ids of the best path, its score, what the second path loses) of each text.

        Scores of a position depend on the text before it alone, so they are
        kept for what a text has in common with the one before: sorted texts
        share most of the work.
        """
        edges, longest = self.edges, self.longest
        best, second, back, before = [0], [NEVER], [None], ""
        for text in texts:
            n = len(text)
            k, most = 0, min(len(before), n)
            while k < most and before[k] == text[k]:
                k += 1
            del best[k + 1 :], second[k + 1 :], back[k + 1 :]
            for j in range(k + 1, n + 1):
                top = next_best = NEVER
                came = None
                for i in range(j - 1, max(-1, j - 1 - longest), -1):
                    edge = edges.get(text[i:j])
                    if edge is None:
                        if i < j - 1:
                            continue
                        edge = self._bytes_edge(text[i])
                    x, y = best[i] + edge[0], second[i] + edge[0]
                    if x > top:
                        next_best = top if top > y else y
                        top, came = x, (i, edge[1])
                    elif x > next_best:
                        next_best = x
                best.append(top)
                second.append(next_best)
                back.append(came)
            before, path, j = text, [], n
            while j:
                j, ids = back[j]
                path.append(ids)
            yield list(chain.from_iterable(reversed(path))), best[n], None if second[n] <= NEVER // 2 else best[n] - second[n]

    def best_paths(self, texts: list[str]) -> dict:
        """viterbi of many texts, by text: those of equal length together, in arrays."""
        out, rest, by_length = {}, [], {}
        for t in texts:
            if len(t) > self.array_chars:
                rest.append(t)
            else:
                by_length.setdefault(len(t), []).append(t)
        for n, group in by_length.items():
            rest += self._equal_lengths(n, group, out)
        rest.sort()
        out.update(zip(rest, self.viterbi(rest)))
        return out

    def _equal_lengths(self, n: int, texts: list[str], out: dict) -> list[str]:
        """Adds the best paths of texts of n characters to out; returns the texts with a character of no piece."""
        m = len(texts)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.int64).ravel()
        at, node = np.arange(n * m), np.zeros(n * m, np.int32)  # places (character, text) that a node of the trie goes on from
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, min(n, self.longest) + 1):
            if size > 1:
                inside = at < (n - size + 1) * m
                at, node = at[inside], node[inside]
            key = (node.astype(np.int64) << CODE_BITS) | codes[at + (size - 1) * m]
            step = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[step] == key
            at, node = at[hit], self.step_nodes[step[hit]]
            score, ids = np.full((n - size + 1) * m, NO_EDGE, np.int32), np.zeros((n - size + 1) * m, np.int32)
            score[at], ids[at] = self.node_score[node], self.node_id[node]
            found[size] = score.reshape(-1, m), ids.reshape(-1, m)
            if not len(at):
                break
        known = (found[1][0] > NO_EDGE).all(axis=0)
        best, second = (np.full((n + 1, m), NO_PATH, np.int32) for _ in range(2))
        best[0] = 0
        came = np.zeros((n + 1, m), np.int8)
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                if size in found:
                    edge = found[size][0][j - size]
                    x, y = best[j - size] + edge, second[j - size] + edge
                    better = x > best[j]
                    second[j] = np.maximum(np.where(better, best[j], np.maximum(second[j], x)), y)
                    best[j] = np.where(better, x, best[j])
                    came[j][better] = size
        path = np.zeros((n, m), np.int32)
        count, at, rows = np.zeros(m, np.int64), np.full(m, n), np.flatnonzero(known)
        while len(rows):
            size = came[at[rows], rows].astype(np.int64)
            at[rows] -= size
            for k in np.unique(size):
                own = rows[size == k]
                path[count[own], own] = found[k][1][at[own], own]
            count[rows] += 1
            rows = rows[at[rows] > 0]
        loss = best[n] - second[n]
        columns = path.T.tolist()
        for t, ok, ids, k, score, lost in zip(texts, known.tolist(), columns, count.tolist(), best[n].tolist(), loss.tolist()):
            if ok:
                out[t] = ids[:k][::-1], score, None if lost > -LEAST else lost
        return [t for t, ok in zip(texts, known.tolist()) if not ok]

    def nbest(self, text: str, n_best: int) -> list[tuple[int, list[int]]]:
        """The n best paths (score, ids) by backward A* with forward Viterbi scores."""
        n = len(text)
        forward: list = [None] * (n + 1)
        forward[0] = 0
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j, score, ids in self._from(text, i):
                into[j].append((i, score, ids))
                if forward[j] is None or forward[i] + score > forward[j]:
                    forward[j] = forward[i] + score
        queue, order, out, taken = [(-forward[n], n, 0, 0, None)], 0, [], [0] * (n + 1)
        while queue and len(out) < n_best:
            total, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-total, ids))
                continue
            if taken[at] == n_best:  # no path of the n best goes on from a later one
                continue
            taken[at] += 1
            for i, score, ids in into[at]:
                order += 1
                heapq.heappush(queue, (-(behind + score + forward[i]), i, order, behind + score, (ids, path)))
        return out


class Encoder:
    """Best paths of chunks in a table of bounded size; others by A* where a text needs them."""

    CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")

    def __init__(self, model: bytes, n_best: int = N_BEST):
        self.pieces, self.n_best = Pieces(model), n_best
        self.clear()

    def clear(self) -> None:
        self.place, self.others = Numbers(), {}
        self.n, self.flat, self.start = 0, np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.score, self.loss = np.empty(1 << 14, np.int64), np.empty(1 << 14)

    def _add(self, chunks: list[str]) -> None:
        """Puts the best paths of chunks into the table: ids, score, loss of the second path."""
        rows = self.pieces.best_paths(chunks)
        rows = [rows[c] for c in chunks]
        first, self.n = self.n, self.n + len(chunks)
        ends = self.start[first] + np.cumsum([len(r[0]) for r in rows])
        self.flat, self.start, self.score, self.loss = (grown(a, size) for a, size in ((self.flat, int(ends[-1])), (self.start, self.n + 1), (self.score, self.n), (self.loss, self.n)))
        self.flat[self.start[first] : ends[-1]] = list(chain.from_iterable(r[0] for r in rows))
        self.start[first + 1 : self.n + 1] = ends
        self.score[first : self.n], self.loss[first : self.n] = [r[1] for r in rows], [math.inf if r[2] is None else r[2] for r in rows]

    def places(self, chunked: list[list[str]]) -> list[np.ndarray]:
        """Numbers in the table of each text's chunks; they hold until the next call."""
        if self.n > CACHE_CHUNKS:
            self.clear()
        found = [np.array(list(map(self.place.__getitem__, chunks)), np.int64) for chunks in chunked]
        if self.place.fresh:
            self._add(self.place.fresh)
            self.place.fresh = []
        return found

    def alternatives(self, chunk: str, best: list[int]) -> list[tuple[int, list[int]]]:
        """(loss, ids) of the next best paths."""
        got = self.others.get(chunk)
        if got is None:
            paths = self.pieces.nbest(chunk, self.n_best)
            got = [(paths[0][0] - s, ids) for s, ids in paths if ids != best][: self.n_best - 1]
            if len(self.others) >= CACHE_OTHERS:
                self.others = {}
            if len(chunk) <= CACHED_CHARS:
                self.others[chunk] = got
        return got

    def encode(self, texts: list[str | None]):
        """(ids, score, [(score, [(at, drop, ids)])]) of each text: the best path, and the edits of the others."""
        chunked = [self.CHUNK.findall(" " + t) if t else [] for t in texts]
        for text, chunks, places in zip(texts, chunked, self.places(chunked)):
            yield (None, None, []) if text is None else self._combined(chunks, places)

    def _combined(self, chunks: list[str], places: np.ndarray):
        if not chunks:
            return np.empty(0, np.int32), 0.0, []
        first, n = self.start[places], self.start[places + 1] - self.start[places]
        start = np.cumsum(n) - n
        ids = self.flat[np.repeat(first - start, n) + np.arange(n.sum())]
        score = int(self.score[places].sum())
        if self.n_best == 1:
            return ids, score / UNIT, []
        loss = self.loss[places]
        k = min(self.n_best - 1, len(chunks))
        if k < len(chunks):
            limit = np.partition(loss, k - 1)[k - 1]
            at = np.flatnonzero(loss < limit).tolist()
            at = sorted(at + np.flatnonzero(loss == limit)[: k - len(at)].tolist())
        else:
            at = list(range(len(chunks)))
        at = [i for i in at if loss[i] < math.inf]
        best = {i: self.flat[first[i] : first[i] + n[i]].tolist() for i in at}
        options = [[(0, None), *self.alternatives(chunks[i], best[i])] for i in at]
        others = []
        queue, seen = [(0, (0,) * len(at))], {(0,) * len(at)}
        while queue and len(others) < self.n_best:
            lost, choice = heapq.heappop(queue)
            others.append((lost, choice))
            for p in range(len(at)):
                if choice[p] + 1 < len(options[p]):
                    more = (*choice[:p], choice[p] + 1, *choice[p + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (sum(options[q][c][0] for q, c in enumerate(more)), more))
        return ids, score / UNIT, [((score - lost) / UNIT, [(int(start[at[p]]), len(best[at[p]]), options[p][c][1]) for p, c in enumerate(choice) if c]) for lost, choice in others[1:]]

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def apply_edits(ids, edits) -> list[int]:
    """The id sequence of another path."""
    out, at, ids = [], 0, list(ids)
    for start, drop, new in edits:
        out += ids[at:start] + list(new)
        at = start + drop
    return out + ids[at:]


_ENCODERS: dict = {}


def encoder(model: bytes, n_best: int) -> Encoder:
    """One encoder for each Python worker; the model's tables last over tasks, what was encoded doesn't."""
    key = (hashlib.sha1(model).digest(), n_best)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, n_best)
    return _ENCODERS[key]


def _extended(df: DataFrame, schema: str) -> tuple[StructType, list[int]]:
    """df's schema with new columns, and the numbers of df's columns that stay: a new column replaces one of its name."""
    new = df.sparkSession.createDataFrame([], schema).schema.fields
    names = {f.name.lower() for f in new}
    stay = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    return StructType([*(df.schema.fields[i] for i in stay), *new]), stay


def encode_texts(df: DataFrame, model: bytes, n_best: int = N_BEST, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """df with ids, score, others: the best path and the edits that give the others, best first.

    With ``decoded``, also with a column of that name: what the ids decode to.
    Null texts give null ids and score and no others; empty ones no ids and the
    score 0. Rows, also repeated ones, and other columns stay as they are; a
    column named like a new one is replaced. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    (out, stay), at = _extended(df, ENCODED + (f", {decoded} string" if decoded else "")), df.columns.index(text_col)

    def run(batches):
        e = encoder(held.value, n_best)
        for b in slices(batches, at, SLICE_BYTES):
            flat, ends, valid, scores, others, texts = [], [0], [], [], [], []
            for ids, score, more in e.encode(b.column(at).to_pylist()):
                valid.append(ids is not None)
                flat.append(np.empty(0, np.int32) if ids is None else ids)
                ends.append(ends[-1] + len(flat[-1]))
                scores.append(score)
                others.append([{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in edits]} for s, edits in more])
                if decoded:
                    texts.append(None if ids is None else e.decode(ids.tolist()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)), mask=pa.array([not v for v in valid]))
            made = [lists, pa.array(scores, pa.float64()), pa.array(others, _OTHERS), *([pa.array(texts, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *made], names=out.names)
        e.clear()  # the worker may serve other stages next

    return df.mapInArrow(run, out)


def decode_ids(df: DataFrame, model: bytes, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of ids_col; null ids give null. A column named like the new one is replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)
    (out, stay), at = _extended(df, f"{to} string"), df.columns.index(ids_col)

    def run(batches):
        e = encoder(held.value, N_BEST)
        for b in batches:
            texts = [None if ids is None else e.decode(ids) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), pa.array(texts, pa.string())], names=out.names)

    return df.mapInArrow(run, out)


def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def session_model(spark: SparkSession) -> bytes:
    """The model that the session names under MODEL_SETTING, else that of MODEL_PATH."""
    return model_bytes(spark.conf.get(MODEL_SETTING, MODEL_PATH))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_texts of all documents: ids, their number and score, the next best paths as edits of the best one, and whether decoding gives the text back. Nulls, blanks, repeats and empty tables as there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, session_model(spark), decoded="decoded").select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        "score",
        "others",
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )
