"""Lines and items that carry nothing: recognition noise, headers, fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, WORD, collapse_space, once, strip
from docloom.functions.vocabulary import EDUCATION_HEADERS, EXPERIENCE_CODES, EXPERIENCE_HEADERS, EXPERIENCE_JUNK, EXPERIENCE_TAILS, JUNK_ENTITIES, STATES

_DIGIT = r"\p{Nd}"

# Patterns of lines that carry nothing.
_NOISE = rf"^(?:[^{WORD}]+|[a-z]{{1,2}}[{SPACE}]+[{WORD}].*|{_DIGIT}+[{SPACE}]*[a-zA-Z]{{0,2}}|(?:[^{WORD}]|{_DIGIT}){{1,4}})$"
_DATES = rf"(?i)^(?:[^{WORD}]|{_DIGIT}){{0,4}}[{SPACE}]*{_DIGIT}{{4}}[{SPACE}]*[-–][{SPACE}]*(?:{_DIGIT}{{4}}|ongoing|present|now|current)"
_OPEN_DATES = rf"(?i)^{_DIGIT}{{4}}[{SPACE}]*[-–—]?[{SPACE}]*(?:present|current|now|ongoing)[{SPACE}]*$"
_CONTACT = rf"(?i)(?:@.*@|linkedin\.com|github\.com|twitter\.com|^[{SPACE}]*[^{WORD}]{{0,3}}[{SPACE}]*[{WORD}]+,[{SPACE}]*[{WORD}]+[{SPACE}]*$)"


# Years, up to three small letters, a letter before up to six characters; of stripped items.
_FRAGMENT = rf"^(?:{_DIGIT}{{1,4}}|{_DIGIT}{{2,4}}[{SPACE}]*[-–—][{SPACE}]*{_DIGIT}{{2,4}}|\p{{Ll}}{{1,3}}|\p{{L}}[{SPACE}]+[^{SPACE}]{{1,6}})\z"


def is_noise(line: Column) -> Column:
    """Blank or very short lines, symbols, numbers, a stray prefix, no ASCII letter, date ranges, contact lines."""
    return once(strip(line), _is_noise)


def _is_noise(s: Column) -> Column:
    return (
        (F.length(s) <= 2)
        | s.rlike(_NOISE)
        | ~s.rlike("[A-Za-z]")
        | (s.rlike(_DATES) & ~s.rlike(_OPEN_DATES))
        | (F.contains(s, F.lit("@")) & s.rlike(_CONTACT))
    )


def is_state(line: Column) -> Column:
    return F.lower(strip(line)).isin(*STATES)


def distinct_first(items: Column, key) -> Column:
    """Items whose key, a function of the item, hasn't come before; in order.

    Sorted by key and place, the first of each key stands after another key; a
    fold would copy its arrays for each item.
    """
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
    first = once(keyed, lambda t: F.filter(t, lambda e, i: (i == 0) | (F.get(t, i - 1)["key"] != e["key"])))
    return F.transform(F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def dedupe_ci(items: Column) -> Column:
    """Stripped items that aren't blank, the first of each but for case."""
    return distinct_first(F.array_remove(F.transform(items, strip), ""), F.lower)


def dedupe_ws(items: Column) -> Column:
    """As dedupe_ci, but white space within doesn't tell items apart either."""
    return distinct_first(F.array_remove(F.transform(items, strip), ""), lambda x: F.lower(collapse_space(x)))


def clean_section_lines(items: Column, drop_states: bool = False) -> Column:
    kept = F.filter(F.transform(items, strip), lambda x: ~_is_noise(x) & ~is_state(x) if drop_states else ~_is_noise(x))
    return distinct_first(kept, lambda x: collapse_space(F.lower(x)))


def entity_ok(s: Column) -> Column:
    """Whether a stripped item has two letters or digits and is no junk."""
    return (F.length(s) >= 2) & ~F.lower(s).isin(*JUNK_ENTITIES) & s.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*+[\p{L}\p{N}]")


def clean_entities(items: Column) -> Column:
    return F.filter(F.transform(items, strip), entity_ok)


def _headed(x: Column) -> Column:
    return strip(F.rtrim(F.lower(x), F.lit(":")))


def clean_experience(items: Column) -> Column:
    """clean_entities without headers, years, and fragments of words."""

    def ok(t: Column) -> Column:
        tail = F.endswith(t, F.lit("zation")) | F.endswith(t, F.lit("isation"))
        return ~(
            _headed(t).isin(*EXPERIENCE_HEADERS, *EXPERIENCE_JUNK, *EXPERIENCE_TAILS)
            | t.rlike(_FRAGMENT)
            | t.isin(*EXPERIENCE_CODES)
            | (tail & (F.length(t) <= 10) & ~F.contains(t, F.lit(" ")) & (F.lower(t) == t))
        )

    return F.filter(clean_entities(items), ok)


def clean_education(items: Column) -> Column:
    return F.filter(clean_entities(items), lambda t: ~_headed(t).isin(*EDUCATION_HEADERS))


def merge_dates(items: Column) -> Column:
    """Joins "YYYY - Present" (or a bare year with or without a dash) with the line after it.

    A greedy fold: a line that was joined starts nothing. At the end a
    "YYYY - Present" is dropped, a bare year stays.
    """
    ongoing = rf"(?i)^{_DIGIT}{{4}}[{SPACE}]*[-–—]?[{SPACE}]*(?:present|current|now|presen|ongoing)\.?[{SPACE}]*$"
    bare = rf"^{_DIGIT}{{4}}[{SPACE}]*[-–—]?[{SPACE}]*$"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, raw: Column) -> Column:
        x = strip(raw)
        opens = x.rlike(ongoing) | x.rlike(bare)
        joined = state["open"].isNotNull() & (x != "")
        out = F.when(joined, F.array_append(state["out"], F.concat_ws(" ", state["open"], x))).when(state["open"].isNotNull() & state["open"].rlike(bare), F.array_append(state["out"], state["open"])).otherwise(state["out"])
        out = F.when(joined | opens, out).otherwise(F.array_append(out, x))
        return F.struct(out.alias("out"), F.when(~joined & opens, x).alias("open"))

    def finish(state: Column) -> Column:
        return F.when(state["open"].rlike(bare), F.array_append(state["out"], state["open"])).otherwise(state["out"])

    return F.aggregate(items, start, step, finish)
