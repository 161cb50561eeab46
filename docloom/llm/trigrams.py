"""Boolean trigram queries of regexes, and a trigram index over a block of texts.

``query_of`` walks the parse tree of a pattern and keeps what every match must
hold: sets of exact strings grow along a concatenation until they are too many,
then become "all trigrams of one of these strings". A query is ``ALL``, a
trigram (bytes), or ("and" | "or", [queries]). It may admit texts that don't
match, never the reverse. Letters are folded to lower case (A-Z).
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np

ALL = None
MOST_STRINGS = 64
MOST_CHARS = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _both(kind: str, parts: list):
    """Simplified conjunction or disjunction."""
    if kind == "and":
        parts = [p for p in parts if p is not ALL]
    elif any(p is ALL for p in parts):
        return ALL
    parts = list(dict.fromkeys(repr(p) for p in parts)) and [p for i, p in enumerate(parts) if repr(p) not in map(repr, parts[:i])]
    if not parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, parts)


def _of_strings(strings: set[str]):
    """Every trigram of one of the strings."""
    options = []
    for s in sorted(strings):
        b = bytes(_LOWER[np.frombuffer(s.encode(), dtype=np.uint8)])
        options.append(_both("and", [b[i : i + 3] for i in range(len(b) - 2)]))
    return _both("or", options)


def _walk(tree):
    """(exact strings or None, query for what isn't exact)."""
    done, exact = [], {""}

    def flush():
        nonlocal exact
        done.append(_of_strings(exact))
        exact = {""}

    for op, arg in tree:
        name, got = str(op), None
        query = ALL
        if name == "LITERAL":
            got = {chr(arg)}
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value))
                elif str(kind) == "RANGE" and value[1] - value[0] < MOST_CHARS:
                    chars |= {chr(c) for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            got = chars if chars and len(chars) <= MOST_CHARS else None
        elif name == "SUBPATTERN":
            got, query = _walk(arg[3])
        elif name == "BRANCH":
            options = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in options) and len(joined := set().union(*(e for e, _ in options))) <= MOST_STRINGS:
                got = joined
            else:
                query = _both("or", [q if e is None else _of_strings(e) for e, q in options])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, item = arg
            inner, inner_query = _walk(item)
            if (low, high) == (0, 1) and inner is not None:
                got = inner | {""}
            elif low == high == 1:
                got, query = inner, inner_query
            elif low > 0:
                query = inner_query if inner is None else _of_strings(inner)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if got is not None and len(exact) * len(got) <= MOST_STRINGS:
            exact = {a + b for a, b in product(exact, got)}
        elif got is not None:
            flush()
            exact = set(got)
        else:
            flush()
            done.append(query)
    if not done:
        return exact, ALL
    flush()
    return None, _both("and", done)


def query_of(pattern: str):
    exact, query = _walk(re._parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def trigrams_of(query) -> set[bytes]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings (sorted text numbers) of the wanted trigrams over texts in one UTF-8 buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: set[bytes]):
        """offsets: n + 1 ends of the texts within data."""
        self.n = len(offsets) - 1
        self.postings: dict[bytes, np.ndarray] = {}
        codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), dtype=np.uint32)
        if not len(codes) or len(data) < 3:
            return
        low = _LOWER[data]
        pair = (low[:-1].astype(np.uint16) << 8) | low[1:]
        seen = np.zeros(65536, dtype=bool)
        seen[codes >> 8] = True
        at = np.flatnonzero(seen[pair[:-1]])  # the first two bytes begin a wanted trigram
        code = (pair[at].astype(np.uint32) << 8) | low[at + 2]
        slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        keep = codes[slot] == code
        at, slot = at[keep], slot[keep]
        text = np.searchsorted(offsets, at, side="right") - 1
        keep = at + 3 <= offsets[text + 1]
        key = np.unique(slot[keep].astype(np.int64) * self.n + text[keep])
        slots, texts = np.divmod(key, max(self.n, 1))
        for i, code in enumerate(codes):
            a, b = np.searchsorted(slots, (i, i + 1))
            self.postings[int(code).to_bytes(3, "big")] = texts[a:b]

    def candidates(self, query) -> np.ndarray:
        """Numbers of the texts that the query admits."""
        if query is ALL:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(query, np.empty(0, dtype=np.int64))
        sets = [self.candidates(q) for q in query[1]]
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, assume_unique=True) if query[0] == "and" else np.union1d(out, s)
        return out
