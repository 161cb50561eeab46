"""Skills of a document: exact for single words, similar word windows for phrases."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docloom.functions.text import WORD, collapse_space, once
from docloom.functions.vocabulary import SKILLS

SIMILAR = 0.85
#: Texts of about so many characters are compared at once; bounds memory, not results.
CHARS_AT_ONCE = 1_000_000


def exact_skills(text: Column, skills=SKILLS) -> Column:
    """Single-word skills that occur as whole words, sorted. Lower-case text with single spaces is expected."""
    if not any(" " not in s for s in skills):
        return F.array().cast("array<string>")
    # skills of letters and digits are looked up among the words, the others have a pattern each
    single = sorted(s for s in set(skills) if " " not in s)
    plain = [s for s in single if re.fullmatch("[a-z0-9]+", s)]
    quoted = {s: "".join(c if c.isalnum() else f"\\{c}" for c in s) for s in single if s not in plain}
    bounded = {s: rf"(?<![{WORD}]){q}(?![{WORD}])" for s, q in quoted.items()}

    def found(t: Column) -> Column:
        same = F.array_intersect(F.split(t, rf"[^{WORD}]+"), F.array(*map(F.lit, plain)).cast("array<string>"))
        return F.concat(same, F.array_compact(F.array(*(F.when(F.contains(t, F.lit(s)) & t.rlike(p), s) for s, p in bounded.items())).cast("array<string>")))

    return F.sort_array(once(F.coalesce(text, F.lit("")), found))


def ngrams(tokens: Column, k: int) -> Column:
    """All windows of k tokens, joined by spaces."""
    return once(tokens, lambda t: _windows(t, k))


def _windows(tokens: Column, k: int) -> Column:
    """ngrams of tokens that are bound."""
    n = F.size(tokens)
    places = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    return F.when(n >= k, F.transform(places, lambda i: F.concat_ws(" ", *(F.get(tokens, i + j) for j in range(k))))).otherwise(F.array().cast("array<string>"))


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return SequenceMatcher(None, a, b).ratio()


def _word_bits(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the words between spaces in all texts: first and last place in the joined texts, number of the text, and a mask of 64 bits, one for each code point modulo 64."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.cumsum([0, *map(len, texts)])
    gap = codes == 32
    cut = np.zeros(len(codes) + 1, bool)  # a text begins here, or the last one has ended
    cut[edges] = True
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1] | cut[1:-1]
    ends[:-1] &= gap[1:] | cut[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bits = np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64))
    bits[gap] = 0
    masks = np.bitwise_or.reduceat(bits, first) if len(first) else bits[:0]
    return first, last, np.searchsorted(edges, first, "right") - 1, masks


def _may_be_similar(phrase: str, sizes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Places of the windows whose ratio to the phrase can be over SIMILAR.

    Characters that just one of the two has are unmatched. So the matching ones
    are at most the phrase's without ``missing``, and the window's without ``extra``.
    """
    mask = np.uint64(sum({1 << (ord(c) & 63) for c in phrase if c != " "}))
    near = np.flatnonzero(2 * np.minimum(sizes, len(phrase)) > SIMILAR * (sizes + len(phrase)) - 1e-6)
    n, m = sizes[near], masks[near]
    missing, extra = np.bitwise_count(mask & ~m).astype(np.int64), np.bitwise_count(m & ~mask).astype(np.int64)
    return near[2 * np.minimum(len(phrase) - missing, n - extra) > SIMILAR * (n + len(phrase)) - 1e-6]


def similar_phrases(texts: list[str], phrases: list[str], known: dict[tuple[str, str], bool]) -> list[list[str]]:
    """For each text the phrases that a window of as many words resembles, in the order given. ``known`` keeps pairs that bounds on all windows left."""
    out: list[list[str]] = [[] for _ in texts]
    whole = "".join(texts)
    first, last, owner, bits = _word_bits(texts)
    counts = {s: [(c, s.count(c)) for c in sorted(set(s))] for s in phrases}

    def similar(s: str, w: str) -> bool:
        if (s, w) not in known:
            if len(known) > 100_000:
                known.clear()
            most = sum(min(n, w.count(c)) for c, n in counts[s])
            known[s, w] = 2.0 * most / (len(s) + len(w)) > SIMILAR and ratio(s, w) > SIMILAR
        return known[s, w]

    windows = {}
    for k in {s.count(" ") + 1 for s in phrases}:
        n = max(0, len(first) - k + 1)
        own = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
        sizes, masks = np.full(len(own), k - 1), np.zeros(len(own), np.uint64)
        for j in range(k):
            sizes, masks = sizes + last[own + j] - first[own + j], masks | bits[own + j]
        windows[k] = own, sizes, masks
    for s in phrases:
        k = s.count(" ") + 1
        own, sizes, masks = windows[k]
        for i in own[_may_be_similar(s, sizes, masks)].tolist():
            have = out[owner[i]]
            if not (have and have[-1] == s) and similar(s, " ".join(w for w in whole[first[i] : last[i + k - 1]].split(" ") if w)):
                have.append(s)
    return out


def with_similar_skills(df: DataFrame, text: Column, to: str, skills=SKILLS) -> DataFrame:
    """df with the phrases that a window of as many words resembles (ratio over SIMILAR).

    Texts reach Python in Arrow batches; bounds on the ratio, for all windows of
    some texts at once, come before the ratio, and pairs are remembered.
    """
    phrases = sorted(s for s in set(skills) if " " in s)
    out = df.withColumn(to, text)
    at = out.columns.index(to)
    shape = StructType([StructField(to, ArrayType(StringType())) if i == at else f for i, f in enumerate(out.schema)])

    def match(batches):
        known: dict[tuple[str, str], bool] = {}
        for b in batches:
            found: list[list[str]] = []
            texts, size = [], 0
            for t in b.column(at):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > CHARS_AT_ONCE:
                    found += similar_phrases(texts, phrases, known)
                    texts, size = [], 0
            found += similar_phrases(texts, phrases, known)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return out.mapInArrow(match, shape)


def search_text(text: Column, section: Column) -> Column:
    """The skills section before the whole text, in lower case with single spaces."""
    return collapse_space(F.lower(F.concat(F.array_join(section, " "), F.lit(" "), text)))


def skills(df: DataFrame, text: Column, section: Column, to: str = "skills", bank=SKILLS) -> DataFrame:
    return skills_in(df.withColumn("_search", search_text(text, section)), "_search", to, bank)


def skills_in(df: DataFrame, search: str, to: str = "skills", bank=SKILLS) -> DataFrame:
    """df with the skills in the column ``search``, which goes."""
    found = df.withColumn("_exact", exact_skills(F.col(search), bank)).withColumnRenamed(search, "_similar")
    out = with_similar_skills(found, F.col("_similar"), "_similar", bank)
    return out.withColumn(to, F.sort_array(F.array_distinct(F.concat("_exact", "_similar")))).drop("_exact", "_similar")
