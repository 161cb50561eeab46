"""Column functions for text: character classes, stripping, cleaning, lines.

Java's own classes are narrower than the Unicode ones meant here, so patterns
use the constants below and look-around instead of word boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.vocabulary import OCR_REPAIRS, PARSER_CONFIDENCE

SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: The characters of SPACE.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"\p{L}\p{N}_"
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
ARTIFACT = "Claire"
MIN_MEANINGFUL_CHARS = 40


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row.

    What a lambda refers to from outside is computed anew for each element; an
    element of an array is bound.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(c: Column, old: str, new: str) -> Column:
    """F.replace, where the old string occurs at all: that is faster to see."""
    return once(c, lambda x: F.when(F.contains(x, F.lit(old)), F.replace(x, F.lit(old), F.lit(new))).otherwise(x))


def collapse_space(c: Column) -> Column:
    """Single spaces for white space; the pattern passes over those that are."""
    return F.regexp_replace(c, rf" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " ")


def words(c: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(c, rf"[{SPACE}]+"), "")


def n_words(c: Column) -> Column:
    """How many words, without an array of them."""
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))


def first_words(c: Column, n: int) -> Column:
    """The first n words; what is after them isn't split."""
    return F.slice(F.array_remove(F.split(strip(c), rf"[{SPACE}]+", n + 1), ""), 1, n)


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.array_remove(F.transform(F.split(c, rf"[{LINE_END}]"), strip), "")


def has_ocr_artifact(c: Column) -> Column:
    """Whether a name that one misreading puts for the letter s occurs 8 times, and in over 4 % of the words."""
    n = F.regexp_count(c, F.lit(f"(?i){ARTIFACT}"))
    # as n_words(c) is 1 at least where n isn't 0
    return (n >= 8) & (n / n_words(c) > 0.04)


def repair_ocr_artifact(c: Column) -> Column:
    """The name inside words back to s, at their start to S; alone it is left. (?d): only \\n ends a line."""
    # Places where the name stands for the letter, in order.
    steps = (
        (rf"(?i)(?<=[A-Za-z]){ARTIFACT}(?=[0-9])", "s"),
        (rf"(?i)(?<![{WORD}]){ARTIFACT}(?=[0-9])", "S"),
        (rf"(?i)(?<=[A-Za-z]){ARTIFACT}(?=[A-Za-z])", "s"),
        (rf"(?i)(?<=[A-Za-z]){ARTIFACT}(?=[^A-Za-z0-9])", "s"),
        (rf"(?imd)(?<=[A-Za-z]){ARTIFACT}$", "s"),
        (rf"(?i)(?<![{WORD}]){ARTIFACT}(?=[A-Za-z])", "S"),
    )
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def normalize_ocr(c: Column) -> Column:
    """Repairs the artifact where it is present, then the literal misreadings in order."""
    c = once(c, lambda x: F.when(has_ocr_artifact(x), repair_ocr_artifact(x)).otherwise(x))
    return reduce(lambda x, pair: replaced(x, *pair), OCR_REPAIRS, c)


def join_at(c: Column) -> Column:
    """No white space around @."""
    joined = lambda x: F.regexp_replace(F.regexp_replace(x, rf"@[{SPACE}]+", "@"), rf"(?<![{SPACE}])[{SPACE}]++@", "@")
    return once(c, lambda x: F.when(F.contains(x, F.lit("@")), joined(x)).otherwise(x))


def clean_text(c: Column) -> Column:
    """Normalised text; nulls become empty."""
    c = replaced(F.coalesce(c, F.lit("")), " ", " ")
    c = normalize_ocr(F.regexp_replace(c, r"\r\n?", "\n"))
    c = replaced(c, "＠", "@")
    c = join_at(c)
    c = F.regexp_replace(c, rf"[^{WORD}{SPACE}@.+#\-/(),:']", " ")
    c = F.regexp_replace(c, r" [ \t]+|\t[ \t]*", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def quality_flag(c: Column) -> Column:
    """low_text under 40 characters, noisy_symbols if over 5 % are control characters up to 3, else ok."""
    c = strip(c)
    odd = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x03]", ""))
    return F.when(F.length(c) < MIN_MEANINGFUL_CHARS, "low_text").when(odd / F.greatest(F.length(c), F.lit(1)) > 0.05, "noisy_symbols").otherwise("ok")


def parser_confidence(flag: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in reversed(PARSER_CONFIDENCE):
        out = F.when(flag == name, value).otherwise(out)
    return F.coalesce(out, F.lit(0.55))


def collapse_pages(pages: Column) -> Column:
    """Stripped pages that aren't blank, one a line."""
    return F.array_join(F.filter(F.transform(pages, strip), lambda p: p != ""), "\n")
