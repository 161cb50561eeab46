"""E-mail addresses and telephone numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, WORD, collapse_space, join_at, once, replaced

DIGIT = r"\p{Nd}"
# The pattern of an address, from a place where its first part begins; whether text has one, sought from the @.
_USER, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL = rf"(?<!{_USER}){_USER}++@{_HOST}"
HAS_EMAIL = rf"@(?<={_USER}@){_HOST}"


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_email(c: Column) -> Column:
    """The first address; else "user domain.tld" with a common top level, else "user at domain.tld", joined by @."""
    ends = rf"(?:(?<=[{WORD}])(?![{WORD}]))"
    begins = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
    bare = rf"(?i){begins}([A-Za-z0-9._%+-]{{2,40}})[{SPACE}]+([A-Za-z0-9][A-Za-z0-9.-]*\.(?:com|net|org|edu|io|co|gov|uk)){ends}"
    spelt = rf"(?i){begins}([A-Za-z0-9._%+-]{{2,40}})[{SPACE}]+at[{SPACE}]+([A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2,}}){ends}"
    # what each of the two must have; sought first, as it takes less than the whole pattern
    hints = (r"(?i)\.(?:com|net|org|edu|io|co|gov|uk)", rf"(?i)[{SPACE}]at[{SPACE}]+[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2}}")

    def found(text: Column) -> Column:
        joined = [F.when(text.rlike(hint), F.concat(_found(text, p, 1), F.lit("@"), _found(text, p, 2))) for hint, p in zip(hints, (bare, spelt), strict=True)]
        return F.coalesce(F.when(F.contains(text, F.lit("@")), _found(text, EMAIL)), *joined)

    return once(join_at(replaced(c, "＠", "@")), found)


def format_phone(digits: Column) -> Column:
    """Digits in groups, by what the number looks like; null if it is none."""
    n = F.length(digits)

    def ten(d: Column) -> Column:
        return F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))

    return (
        F.when(~digits.rlike(r"^[0-9]+$") | (n < 10), None)
        .when(digits.rlike("^01[0125][0-9]{8}$"), F.concat_ws(" ", F.substring(digits, 1, 3), F.substring(digits, 4, 4), F.substring(digits, 8, 4)))
        .when(n == 10, ten(digits))
        .when(digits.rlike("^1[3-9][0-9]{9}$"), ten(F.substring(digits, 2, 10)))
        .when(n.between(11, 15), F.concat(F.lit("+"), digits))
    )


# The patterns of telephone numbers.
US = rf"(?<!{DIGIT})(?:\+?{DIGIT}{{1,3}}[{SPACE}.-]?)?\(?{DIGIT}{{3}}\)?[{SPACE}.-]?{DIGIT}{{3}}[{SPACE}.-]?{DIGIT}{{4}}(?!{DIGIT})"
LOOSE = rf"(?<!{DIGIT})(?:\+?{DIGIT}{{1,3}}[{SPACE}.-]?)?{DIGIT}{{2,4}}[{SPACE}.-]{DIGIT}{{3,4}}[{SPACE}.-]{DIGIT}{{3,4}}(?!{DIGIT})"


def first_phone(c: Column) -> Column:
    """+20 and ten digits; else a mobile number 01[0125] in the text without white space; else the first good match of two patterns."""
    return once(_around_digits(c), _first_phone)


def _around_digits(c: Column) -> Column:
    """The text with what no number has within, up to the last such character between two digits, as one letter."""
    between = rf"{SPACE}\x{{200b}}-\x{{200d}}\x{{fe0f}}+().\-"
    return F.regexp_replace(c, rf"(?<!\P{{Nd}})\P{{Nd}}*[^\p{{Nd}}{between}]", "x")


def _first_phone(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"[\x{200b}-\x{200d}\x{fe0f}\x{a0}]", " ")
    intl = _found(spaced, rf"(?<!{DIGIT})\+20[{SPACE}]*([1-9][0-9]{{9}})(?!{DIGIT})", 1)
    intl = F.concat(F.lit("+20 "), F.substring(intl, 1, 2), F.lit(" "), F.substring(intl, 3, 4), F.lit(" "), F.substring(intl, 7, 4))
    mobile = _found(F.regexp_replace(c, rf"[{SPACE}]+", ""), rf"(?<!{DIGIT})01[0125][0-9]{{8}}(?!{DIGIT})")
    flat = collapse_space(c)
    matches = F.concat(*(F.regexp_extract_all(flat, F.lit(p), 0) for p in (US, LOOSE)))

    def usable(d: Column) -> Column:
        return d.rlike("^01[0125][0-9]{8}$") | (F.length(d) == 10) | (d.rlike("^1[3-9]") & F.length(d).between(11, 15))

    def formatted(d: Column) -> Column:
        return format_phone(F.when((F.length(d) > 10) & d.rlike("^1[3-9]"), F.substring(d, 2, 15)).otherwise(d))

    good = F.transform(F.filter(F.transform(matches, lambda m: F.regexp_replace(m, rf"[^{DIGIT}]", "")), usable), formatted)
    return F.coalesce(intl, once(mobile, format_phone), F.get(F.filter(good, lambda p: p.isNotNull()), F.lit(0)))
