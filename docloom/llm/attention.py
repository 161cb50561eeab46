"""A small causal self-attention language model in numpy.

Inputs are subword ids, each predicted from those before it in its window. An
attention head with a learned bias for each distance reads the window; a hidden
layer on the last RECENT embeddings and the head's output predicts the next id with
a two-level softmax over all ids: leaves are the ids in order of frequency,
``Layout.k`` classes of ``k`` leaves. Ids that the corpus doesn't have share the
last leaf in equal parts; there is nothing to tell them apart by. So the layout
grows with the ids in use, and probabilities sum to 1.

An embedding is multiplied by the weights that read it once for each leaf, not for each
place (``_table``). Training is Adam with plain backpropagation. ``state`` is a flat vector, so that
models trained on parts of a corpus can be averaged. Scoring goes through tiles of
fixed shape, padded: a text's score doesn't depend on what is scored with it.
"""

from __future__ import annotations

import math

import numpy as np

WIDTH, HEAD, HIDDEN = 24, 8, 32
#: Last ids whose embeddings the hidden layer reads itself.
RECENT = 3
WINDOW, STRIDE = 32, 24
#: Windows, rows of a class, and tiles of such rows that are scored at a time.
BATCH, TILE, BLOCK = 64, 16, 64
SEED = 11
#: exp of it, times a row's length, is finite in single precision.
MOST_LOGIT = np.float32(60)
#: Rows that are added up at a time.
_SUMMED = 8
_NEVER = np.float32(-1e4)
_F = np.float32


class Layout:
    """Leaf of each id: ids in use by frequency (ties: smaller id), then one leaf for the others."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        order = np.lexsort((np.arange(len(counts)), -counts))
        used = int((counts > 0).sum())
        self.leaves = used + (used < len(counts))
        self.k = max(2, math.ceil(math.sqrt(self.leaves)))
        self.leaf = np.full(len(counts), used, np.int32)
        self.leaf[order[:used]] = np.arange(used)
        self.shared = math.log(max(1, len(counts) - used))  # of the ids that share a leaf

    def shapes(self) -> dict[str, tuple[int, ...]]:
        k = self.k
        return {
            "emb": (self.leaves, WIDTH),
            "qkv": (WIDTH, 3 * HEAD),
            "distance": (WINDOW,),
            "hidden": (RECENT * WIDTH + HEAD + 1, HIDDEN),  # the last row is the bias
            "classes": (HIDDEN, k),
            "class_bias": (k,),
            "members": (k, HIDDEN, k),
            "member_bias": (k, k),
        }

    def blank(self) -> np.ndarray:
        """First state: random weights, biases at the log frequencies."""
        rng, k = np.random.default_rng(SEED), self.k
        q = np.zeros(k * k)
        np.add.at(q, self.leaf, self.counts + 0.5 * (self.counts > 0))
        q[: self.leaves] += 0.5
        q /= q.sum()
        p = {name: np.zeros(shape) for name, shape in self.shapes().items()}
        p["emb"] = rng.normal(0, 0.5, p["emb"].shape)
        for name in ("qkv", "hidden"):
            p[name] = rng.normal(0, 1 / math.sqrt(p[name].shape[0]), p[name].shape)
        p["distance"] = -0.1 * np.arange(WINDOW)
        by_class = q.reshape(k, k).sum(axis=1)
        p["class_bias"] = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-300)), _NEVER)
        p["member_bias"] = np.where(q > 0, np.log(np.maximum(q, 1e-300)), _NEVER).reshape(k, k)
        return np.concatenate([p[name].ravel() for name in self.shapes()]).astype(_F)


class Attention:
    def __init__(self, state: np.ndarray, layout: Layout):
        self.state, self.layout = np.array(state, _F), layout
        self.p, at = {}, 0
        for name, shape in layout.shapes().items():
            n = math.prod(shape)
            self.p[name] = self.state[at : at + n].reshape(shape)  # views of state
            at += n
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]
        self.gap, self.future = np.maximum(gap, 0), gap < 0
        self._kept = None

    def _bias(self) -> np.ndarray:
        return np.where(self.future, _NEVER, self.p["distance"][self.gap]).astype(_F)

    def _reads(self) -> np.ndarray:
        """What an embedding is multiplied by: as query, key and value, as the last one, the one before and so on."""
        local = self.p["hidden"][: RECENT * WIDTH].reshape(RECENT, WIDTH, HIDDEN)
        return np.concatenate([self.p["qkv"], *local], axis=1)

    def _tables(self, emb: np.ndarray, reads: np.ndarray) -> list[np.ndarray]:
        """Products of embeddings and ``reads``: queries, keys, values and a column that sums weights; the others, the last row for no embedding."""
        products = emb @ reads
        tables = [np.ones((len(emb), 3 * HEAD + 1), _F), *np.zeros((RECENT, len(emb) + 1, HIDDEN), _F)]
        tables[0][:, :-1] = products[:, : 3 * HEAD]
        for back in range(RECENT):
            tables[1 + back][:-1] = products[:, 3 * HEAD + back * HIDDEN :][:, :HIDDEN]
        tables[1] += self.p["hidden"][-1]
        return tables

    def _read(self, tables: list[np.ndarray], x: np.ndarray, bias: np.ndarray, skip: int = 0):
        """Hidden layer of windows of rows of the tables (n x WINDOW), without the first ``skip`` places, and what backpropagation needs."""
        t = np.take(tables[0], x.ravel(), axis=0, mode="clip").reshape(*x.shape, -1)
        q, k, v = t[:, skip:, :HEAD], t[..., HEAD : 2 * HEAD], t[..., 2 * HEAD :]
        a = q @ k.swapaxes(-1, -2)
        a += bias[skip:]
        _exp(a)
        o = a @ v
        seen = o[..., :HEAD] / o[..., HEAD:]
        h = (seen @ self.p["hidden"][RECENT * WIDTH : -1]).reshape(-1, HIDDEN)
        before, row = np.full((len(x), RECENT - 1 + WINDOW), len(tables[0])), np.empty_like(h)
        before[:, RECENT - 1 :] = x
        for back in range(RECENT):
            h += np.take(tables[1 + back], before[:, RECENT - 1 - back + skip :][:, : WINDOW - skip].ravel(), axis=0, out=row, mode="clip")
        np.maximum(h, 0, out=h)
        return q, k, v, a, o, seen, h

    def _tree(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of their members, biases as last rows."""
        p = self.p
        return np.concatenate((p["classes"], p["class_bias"][None])), np.concatenate((p["members"], p["member_bias"][:, None]), axis=1)

    def _frozen(self):
        """Tables and tree of the state as it is, kept until it is another."""
        if self._kept is None or not np.array_equal(self._kept[0], self.state):
            self._kept = self.state.copy(), self._tables(self.p["emb"], self._reads()), *self._tree()
        return self._kept[1:]

    def log_probs(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the ids y where scored (in row order); x: the leaves that the windows read."""
        leaf = self.layout.leaf[y[scored]]
        n, k = len(leaf), self.layout.k
        if not n:
            return np.empty(0, _F)
        tables, classes, members = self._frozen()
        bias, hidden = self._bias(), np.ones((n + 1, HIDDEN + 1), _F)
        hidden[n] = 0
        number = np.cumsum(scored).reshape(scored.shape) - 1
        early = scored[:, : WINDOW - STRIDE].any(axis=1)
        for which, skip in ((np.flatnonzero(early), 0), (np.flatnonzero(~early), WINDOW - STRIDE)):
            for i in range(0, len(which), BATCH):
                part = which[i : i + BATCH]
                leaves = np.zeros((BATCH, WINDOW), x.dtype)
                leaves[: len(part)] = x[part]
                at = np.flatnonzero(scored[part, skip:])
                hidden[number[part, skip:].ravel()[at], :HIDDEN] = np.take(self._read(tables, leaves, bias, skip)[-1], at, axis=0, mode="clip")
        own, inside = leaf // k, leaf % k
        # Rows by class, each class padded to whole tiles, all to whole blocks of tiles. Logits stand in columns: in a
        # product of this form and size all columns are treated alike, in larger ones and of rows they aren't.
        order = np.argsort(own.astype(np.int16), kind="stable")
        sizes = np.bincount(own, minlength=k)
        tiles = -(-sizes // TILE)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) + np.repeat((np.cumsum(tiles) - tiles) * TILE - (np.cumsum(sizes) - sizes), sizes)
        size, of = BLOCK * TILE, np.repeat(np.arange(k), tiles)
        source, at = np.full(-(-len(of) // BLOCK) * size, n), np.zeros((2, -(-len(of) // BLOCK) * size), np.int64)
        source[place], at[0, place], at[1, place] = np.arange(n), own, inside
        wide = size + TILE  # rows of logits that begin at other places of the cache's lines
        at = at.reshape(2, -1, size) * wide + np.arange(size)
        out = np.empty(len(source), _F)
        rows, logits = np.empty((size, HIDDEN + 1), _F), np.zeros((k, wide), _F)
        tiled, by_tile = rows.reshape(BLOCK, TILE, -1).swapaxes(1, 2), logits[:, :size].reshape(k, BLOCK, TILE).swapaxes(0, 1)
        for i in range(len(source) // size):
            np.take(hidden, source[i * size : (i + 1) * size], axis=0, out=rows, mode="clip")
            np.matmul(classes.T, tiled, out=by_tile)
            first = _log_softmax_at(logits, at[0, i])
            held = of[i * BLOCK : (i + 1) * BLOCK]
            ends = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
            for a, b in zip(ends, ends[1:]):
                np.matmul(members[held[a]].T, tiled[a:b], out=by_tile[a:b])
            out[i * size : (i + 1) * size] = first + _log_softmax_at(logits, at[1, i])
        return out[place] - _F(self.layout.shared) * (self.layout.counts[y[scored]] <= 0)

    def gradient(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean negative log probability, and its sum (without the shares of ids that share a leaf)."""
        p, n, k = self.p, len(x), self.layout.k
        row = x.ravel()
        by_row = np.argsort(row.astype(np.uint16), kind="stable") if self.layout.leaves < 1 << 16 else np.argsort(row, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(row[by_row]) > 0])
        used, number = row[by_row[first]], np.empty(len(row), np.int64)
        number[by_row] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)]))
        emb, reads = p["emb"][used], self._reads()
        q, key, v, a, o, seen, h = self._read(self._tables(emb, reads), number.reshape(n, WINDOW), self._bias())
        leaf = self.layout.leaf[y[scored]]
        own = leaf // k
        order = np.argsort(own.astype(np.int16), kind="stable")
        at = np.flatnonzero(scored)[order]
        own, inside = own[order], leaf[order] % k
        hs, (classes, members) = np.ones((len(at), HIDDEN + 1), _F), self._tree()
        hs[:, :HIDDEN] = h[at]
        g = {name: np.zeros_like(p[name]) for name in ("members", "member_bias", "emb")}
        d = hs @ classes
        loss = _softmax_less(d, own)
        both = hs.T @ d
        g["classes"], g["class_bias"] = both[:-1], both[-1]
        dh_s = d @ p["classes"].T
        ends = np.searchsorted(own, np.arange(k + 1))
        parts = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(np.diff(ends)).tolist()]
        for c, rows in parts:
            np.matmul(hs[rows], members[c], out=d[rows])
        loss += _softmax_less(d, inside)
        for c, rows in parts:
            both = hs[rows].T @ d[rows]
            g["members"][c], g["member_bias"][c] = both[:-1], both[-1]
            dh_s[rows] += d[rows] @ p["members"][c].T
        dh_s *= hs[:, :HIDDEN] > 0
        dh = np.zeros_like(h)
        dh[at] = dh_s
        to_seen = p["hidden"][RECENT * WIDTH : -1]
        do = np.empty_like(o)
        np.divide((dh @ to_seen.T).reshape(seen.shape), o[..., HEAD:], out=do[..., :HEAD])
        np.negative(np.einsum("ijk,ijk->ij", do[..., :HEAD], seen), out=do[..., HEAD])
        ds = do @ v.swapaxes(-1, -2)
        ds *= a
        g["distance"] = np.bincount(self.gap.ravel(), (np.ones((1, n), _F) @ ds.reshape(n, -1)).ravel(), WINDOW).astype(_F)
        dt = np.zeros((n * WINDOW + 1, reads.shape[1]), _F)  # the last row stays empty
        d, dw = dt[:-1].reshape(n, WINDOW, -1), dh.reshape(n, WINDOW, HIDDEN)
        np.matmul(ds, key, out=d[..., :HEAD])
        np.matmul(ds.swapaxes(-1, -2), q, out=d[..., HEAD : 2 * HEAD])
        np.matmul(a.swapaxes(-1, -2), do[..., :HEAD], out=d[..., 2 * HEAD : 3 * HEAD])
        for back in range(RECENT):
            d[:, : WINDOW - back, 3 * HEAD + back * HIDDEN :][..., :HIDDEN] = dw[:, back:]
        dt = _sums(dt, by_row, first)
        g["emb"][used] = dt @ reads.T
        dr = emb.T @ dt
        g["qkv"], g["hidden"] = dr[:, : 3 * HEAD], np.empty_like(p["hidden"])
        for back in range(RECENT):
            g["hidden"][back * WIDTH : (back + 1) * WIDTH] = dr[:, 3 * HEAD + back * HIDDEN :][:, :HIDDEN]
        g["hidden"][RECENT * WIDTH : -1] = seen.reshape(-1, HEAD).T @ dh
        g["hidden"][-1] = np.ones(len(dh), _F) @ dh
        return g, loss


class Adam:
    """Adam over the flat state of a model."""

    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m, self.v = np.zeros_like(model.state), np.zeros_like(model.state)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        flat = np.concatenate([g[name].ravel() for name in self.model.layout.shapes()])
        self.m += _F(0.1) * (flat - self.m)
        flat *= flat
        flat -= self.v
        self.v += _F(0.01) * flat
        np.sqrt(self.v, out=flat)
        flat *= _F(1 / math.sqrt(1 - 0.99**self.t))
        flat += _F(1e-7)
        np.divide(self.m, flat, out=flat)
        flat *= _F(rate / (1 - 0.9**self.t))
        self.model.state -= flat


def _exp(x: np.ndarray) -> None:
    """In place, of MOST_LOGIT at most."""
    if x.max(initial=0) > MOST_LOGIT:
        np.minimum(x, MOST_LOGIT, out=x)
    np.exp(x, out=x)


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows, taken in an order, from each ``first`` on to the next. The last row is zeros, and not in the order."""
    while True:
        n = np.diff(np.r_[first, len(order)])
        groups = -(-n // _SUMMED)
        ends = np.cumsum(groups)
        at = np.full(ends[-1] * _SUMMED, len(rows) - 1)
        at[np.arange(len(order)) + np.repeat((ends - groups) * _SUMMED - first, n)] = order
        total = np.zeros((ends[-1] + 1, rows.shape[1]), rows.dtype)
        np.add.reduce(np.take(rows, at, axis=0, mode="clip").reshape(-1, _SUMMED, rows.shape[1]), axis=1, out=total[:-1])
        if len(first) == ends[-1]:
            return total[:-1]
        rows, order, first = total, np.arange(ends[-1]), ends - groups


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the first columns of logits, each column's value at its place in the whole."""
    own = np.minimum(logits.ravel().take(at), MOST_LOGIT)
    _exp(logits)
    return own - np.log(logits.sum(axis=0)[: len(at)])


def _softmax_less(x: np.ndarray, at: np.ndarray) -> float:
    """Makes logits the gradient of the mean negative log probability of the places ``at``; gives its sum."""
    n = len(x)
    _exp(x)
    total = x @ np.ones((x.shape[1], 1), _F)
    total *= n
    np.divide(1, total, out=total)
    x *= total
    own = x[np.arange(n), at]
    x[np.arange(n), at] = own - _F(1 / n)
    return -float(np.log(np.maximum(own * _F(n), 1e-30)).sum())


def windows(sequences: list[np.ndarray], leaf: np.ndarray, start: int, stride: int = STRIDE):
    """Overlapping windows of id sequences: leaves read, ids, and which to score (each id once, with the most context).

    An id is read one place after its own; the first place of a sequence reads ``start``.
    """
    length = np.array([len(s) for s in sequences])
    n = np.maximum(1, -(-(length - WINDOW) // stride) + 1)
    total = int(n.sum())
    flat = np.concatenate([*sequences, np.zeros(WINDOW, np.int32)]) if sequences else np.zeros(WINDOW, np.int32)
    base = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(sequences)), n)
    number = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    inside = (number * stride)[:, None] + np.arange(WINDOW)[None]  # place within the sequence
    at = base[owner][:, None] + inside
    y = flat[np.minimum(at, len(flat) - 1)]
    before = leaf[flat[np.maximum(np.minimum(at - 1, len(flat) - 1), 0)]]
    x = np.where(inside == 0, leaf[start], before)
    scored = (inside < length[owner][:, None]) & ((np.arange(WINDOW)[None] >= WINDOW - stride) | (number == 0)[:, None])
    return x, y, scored, owner
