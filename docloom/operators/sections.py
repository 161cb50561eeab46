"""Sections of a document, by header lines.

A line is a header of the first keyword that it starts with; what follows a
colon stays as text. One row a document: the fold over lines is an array
expression, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.noise import clean_section_lines, merge_dates
from docloom.functions.text import lines, once, strip
from docloom.functions.vocabulary import SECTIONS


def keyword_table(sections=SECTIONS) -> Column:
    return F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("keyword")) for s, ks in sections for k in ks))


def header_of(line: Column, sections=SECTIONS) -> Column:
    """(section, keyword) of a header line, else null.

    A keyword counts if the line equals it, if it is what stands before the
    colon, or if the line starts with it; the last covers the others.
    """
    return once(F.lower(line), lambda low: F.get(F.filter(keyword_table(sections), lambda k: F.startswith(low, k["keyword"])), F.lit(0)))


def header_tail(line: Column, keyword: Column) -> Column:
    """Text after the colon if just the keyword stands before it and the line isn't the keyword."""
    head = F.lower(strip(F.substring_index(line, ":", 1)))
    tail = strip(F.regexp_replace(line, "(?s)^[^:]*:", ""))
    return F.when(F.contains(line, F.lit(":")) & (head == keyword), F.nullif(tail, F.lit("")))


def tagged_lines(text: Column, sections=SECTIONS) -> Column:
    """array<struct<section, line>> of the lines below headers; lines above the first one are left out."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("section"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))
    rows = F.transform(lines(text), lambda x: F.struct(x.alias("line"), header_of(x, sections).alias("h")))

    def step(state: Column, row: Column) -> Column:
        is_header = row["h"].isNotNull()
        section = F.when(is_header, row["h"]["section"]).otherwise(state["section"])
        line = F.when(is_header, header_tail(row["line"], row["h"]["keyword"])).otherwise(row["line"])
        out = F.when(section.isNull() | line.isNull(), state["out"]).otherwise(F.array_append(state["out"], F.struct(section.alias("section"), line.alias("line"))))
        return F.struct(section.alias("section"), out.alias("out"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def section_lines(tagged: Column, section: str) -> Column:
    """Cleaned lines of a section; in education states go and dates are joined with what follows."""
    own = F.transform(F.filter(tagged, lambda x: x["section"] == section), lambda x: x["line"])
    return merge_dates(clean_section_lines(own, drop_states=True)) if section == "education" else clean_section_lines(own)


def sections(df: DataFrame, text_col: str = "text", table=SECTIONS) -> DataFrame:
    """df with ``tagged`` lines and one array column for each section."""
    out = df.withColumn("tagged", tagged_lines(F.col(text_col), table))
    return out.withColumns({name: section_lines(F.col("tagged"), name) for name, _ in table})
