"""Profiles: name, e-mail, phone, skills, education and experience of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.contact import first_email, first_phone
from docloom.functions.names import best_name, name_is_bad, name_score
from docloom.functions.noise import clean_education, clean_entities, clean_experience, dedupe_ci, merge_dates
from docloom.functions.text import clean_text, lines, parser_confidence
from docloom.functions.vocabulary import SKILLS
from docloom.operators.sections import section_lines, tagged_lines
from docloom.operators.skills import search_text, skills_in

CONFIDENCE = 0.62


def profile(df: DataFrame, text_col: str = "text", bank=SKILLS, clean_to: str | None = None) -> DataFrame:
    """df's other columns with the profile of each document's cleaned text. Native but for phrase similarity.

    The cleaned text itself is kept as ``clean_to``, if that is given.
    """
    text, rest = F.col("_clean"), [c for c in df.columns if c != text_col]
    out = df.select(*rest, clean_text(F.col(text_col)).alias("_clean")).withColumn("_tagged", tagged_lines(text))
    found = out.select(
        *rest,
        *([text.alias(clean_to)] if clean_to else []),
        best_name(lines(text)).alias("name"),
        first_email(text).alias("email"),
        first_phone(text).alias("phone"),
        search_text(text, section_lines(F.col("_tagged"), "skills")).alias("_search"),
        dedupe_ci(section_lines(F.col("_tagged"), "education")).alias("education"),
        dedupe_ci(section_lines(F.col("_tagged"), "experience")).alias("experience"),
        F.when(text == "", 0.0).otherwise(CONFIDENCE).alias("confidence"),
        F.length(text).alias("text_length"),
    )
    # only what is left of a document passes through Python
    out = skills_in(found, "_search", bank=bank)
    return out.withColumn("skills", dedupe_ci(F.col("skills"))).select(*rest, *([clean_to] if clean_to else []), "name", "email", "phone", "skills", "education", "experience", "confidence", "text_length")


def name_candidates(text: Column, most: int = 10) -> Column:
    """First lines with their scores."""
    return F.transform(F.slice(lines(text), 1, most), lambda x: F.struct(x.alias("line"), name_score(x).alias("score")))


def debug_view(raw: Column, text: Column) -> list[Column]:
    """Samples of a document for inspection."""
    return [
        F.substring(raw, 1, 500).alias("raw_sample"),
        F.substring(text, 1, 500).alias("clean_sample"),
        F.slice(F.split(text, "\n", 21), 1, 20).alias("lines"),
        name_candidates(text).alias("name_candidates"),
    ]


def backend(mock: Column, model_ready: Column, error: Column) -> Column:
    """Which way a document goes: heuristics alone, a model with heuristics, or heuristics after the model failed."""
    return F.when(mock, "mock_heuristic").when(~model_ready, "mock_heuristic").when(error.isNotNull(), "mock_heuristic_fallback").otherwise("ner_hybrid")


def hybrid_merge(df: DataFrame) -> DataFrame:
    """Joins a model's profile (column ``ner``) with a heuristic one (``heuristic``), item lists in that order.

    Both are structs of name, email, phone, skills, education, experience and
    confidence; ``n_entities`` counts the model's entities.
    """
    n, h = F.col("ner"), F.col("heuristic")
    use = n["name"].isNotNull() & ~name_is_bad(n["name"])
    empty = F.array().cast("array<string>")
    items = lambda x, f: F.coalesce(x[f], empty)
    merged = F.struct(
        F.when(use, n["name"]).otherwise(h["name"]).alias("name"),
        F.coalesce(h["email"], n["email"]).alias("email"),
        F.coalesce(h["phone"], n["phone"]).alias("phone"),
        dedupe_ci(F.concat(clean_entities(items(n, "skills")), items(h, "skills"))).alias("skills"),
        merge_dates(dedupe_ci(F.concat(clean_education(items(n, "education")), items(h, "education")))).alias("education"),
        dedupe_ci(F.concat(clean_experience(items(n, "experience")), items(h, "experience"))).alias("experience"),
        F.when(F.col("n_entities") > 0, F.greatest(n["confidence"], h["confidence"])).otherwise(h["confidence"]).alias("confidence"),
    )
    return df.withColumn("merged", merged)


def response(df: DataFrame, metadata: dict[str, Column] | None = None, debug: Column | None = None) -> DataFrame:
    """Each profile as one JSON document, null scalars kept out.

    ``metadata`` adds what the caller knows of the request (``request_metadata``),
    ``debug`` a part for inspection, such as a struct of ``debug_view``.
    """
    more = [c.alias(name) for name, c in (metadata or {}).items()]
    parts = [F.struct("name", "email", "phone", "skills", "education", "experience").alias("profile"), F.struct("confidence", "text_length", *more).alias("metadata")]
    return df.withColumn("json", F.to_json(F.struct(*parts, *([debug.alias("debug")] if debug is not None else []))))


def request_metadata(parser: Column, quality: Column, way: Column, started: Column | None = None) -> dict[str, Column]:
    """Parser, quality and its confidence, backend, and a request id and the milliseconds so far; the last two differ from run to run."""
    out = {"request_id": F.expr("uuid()"), "parser_used": parser, "quality_flag": quality, "parser_confidence": parser_confidence(quality), "inference_backend": way}
    if started is not None:
        out["processing_ms"] = F.greatest(F.lit(0), F.unix_millis(F.current_timestamp()) - F.unix_millis(started)).cast("int")
    return out
