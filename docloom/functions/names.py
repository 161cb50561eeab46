"""Scores for lines that may be a person's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, once, strip, words
from docloom.functions.vocabulary import BAD_NAME_WORDS, HEADERS, NAME_STOPWORDS, SKILL_PHRASE_WORDS, STATE_CODES


_LONGEST = max(map(len, NAME_STOPWORDS + HEADERS))
_FIVE_WORDS = rf"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{4}}[^{SPACE}]"


def is_upper(c: Column) -> Column:
    """At least one cased letter, and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(c: Column) -> Column:
    """Upper case begins each run of cased letters, and only there."""
    return c.rlike(r"[\p{Lu}\p{Lt}]") & ~c.rlike(r"[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}]|(?<![\p{Lu}\p{Lt}\p{Ll}])\p{Ll}")


def looks_like_company_city_state(line: Column) -> Column:
    """Four or more words, and two commas, or a comma with a state code (or two letters in title case) at the end."""
    return once(F.struct(line.alias("line"), words(line).alias("words")), lambda x: _company(x["line"], x["words"]))


def _company(line: Column, ws: Column) -> Column:
    s = strip(line)
    tail = F.regexp_extract(s, rf",[{SPACE}]*([A-Za-z]{{1,3}})[{SPACE}]*$", 1)
    state = F.upper(tail).isin(*STATE_CODES) | tail.rlike("^[A-Z][a-z]$")
    return (F.size(ws) >= 4) & F.contains(s, F.lit(",")) & (s.rlike(",[^,]*,") | ((F.length(tail) == 2) & state))


def name_score(line: Column) -> Column:
    bound = F.struct(line.alias("line"), F.lower(line).alias("low"), words(line).alias("words"))
    return once(bound, lambda x: _name_score(x["line"], x["low"], x["words"]))


def _name_score(line: Column, low: Column, ws: Column) -> Column:
    """name_score of a line that is bound with its words."""
    n = F.size(ws)
    few = n.between(2, 4)
    plain = F.trim(F.regexp_replace(low, rf"[^a-z{SPACE}]", ""))
    named = F.forall(ws, lambda w: w.rlike(r"^[A-Za-z][a-z'\-]*$") | is_upper(w))
    points = (
        F.when(few, 2).when(n > 4, -2).otherwise(0),
        F.when(line.rlike(r"[\p{Nd}\p{No}]"), -3).otherwise(0),
        F.when(F.contains(line, F.lit("@")) | F.contains(low, F.lit("http")), -3).otherwise(0),
        F.when(is_upper(line) & few, 3).when(is_title(line), 2).otherwise(0),
        F.when(F.length(line) < 40, 1).otherwise(0),
        F.when(_company(line, ws), -10).otherwise(0),
        # a line with more letters than any of the words is none of them
        F.when(~low.rlike(rf"^(?:[^a-z]*+[a-z]){{{_LONGEST + 1}}}") & plain.isin(*NAME_STOPWORDS, *HEADERS), -5).otherwise(0),
        F.when(F.exists(ws, lambda w: F.lower(w).isin(*SKILL_PHRASE_WORDS)), -4).otherwise(0),
        F.when(~named, -2).otherwise(0),
    )
    return sum(points[1:], points[0])


def capitalized(line: Column) -> Column:
    """Each word with its first letter in upper case and the rest in lower case."""
    return F.array_join(F.transform(words(line), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " ")


def best_name(lines: Column, most: int = 15) -> Column:
    """Of the first lines, the earliest with the highest score above 0 that is no employer with city and state."""
    # over four words in 40 characters or more have no score above 0
    able = F.filter(F.slice(lines, 1, most), lambda x: (F.length(x) < 40) | ~x.rlike(_FIVE_WORDS))
    scored = F.transform(able, lambda x, i: F.struct((-name_score(x)).alias("s"), i.alias("i"), x.alias("line")))
    good = F.filter(scored, lambda x: (x["s"] < 0) & ~looks_like_company_city_state(x["line"]))
    return capitalized(F.array_min(good)["line"])


def name_is_bad(name: Column) -> Column:
    """Under 3 characters, with one of some words, or with fewer than two words of letters alone."""
    low = F.lower(name)
    listed = F.exists(F.array(*map(F.lit, BAD_NAME_WORDS)), lambda b: F.contains(low, b))
    return name.isNull() | (F.length(strip(name)) < 3) | listed | (F.size(F.filter(words(name), lambda w: w.rlike(r"^\p{L}+$"))) < 2)
