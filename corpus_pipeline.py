"""The corpus pipeline: five stages from raw documents to encoded, clean ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, pieces, quality, secrets
from docloom.llm.common import Workspace, mark, read, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go.

    Null and empty texts are scored like any other; rows with null ids are scored and
    teach nothing; repeated rows have equal scores. Other columns pass through.
    """
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Blank and null texts have no copies and stay; of rows equal in all columns one
    stays; null ids are ids like others. Other columns pass through.
    """
    return jaccard.one_of_each(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    The text alone decides, so repeated rows go or stay together and ids may be null;
    null and empty texts stay. Other columns pass through.
    """
    return decontam.drop_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; n_chars, if there, follows the text where both are known.

    Null texts stay null, empty ones empty; repeated rows are masked alike. Other columns pass through.
    """
    masked = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    known = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
    return masked.withColumn("n_chars", F.when(known, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every text, the score of that path and of the next best ones, and whether decoding gives the text back.

    doc_id, lang, source and n_chars, as far as they are there, stay; other columns go. Null
    texts have null ids, empty ones none. A row for each row, also repeated ones.
    """
    kept = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    encoded = pieces.encode_texts(docs.select(*kept, "text"), pieces.session_model(spark), decoded="decoded")
    return encoded.select(*kept, "ids", "score", F.transform("others", lambda o: o["score"]).alias("other_scores"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("pieces", pieces_stage),
]

ORACLE_SQL = None  # no stage but the fourth can be put in SQL; each has its test against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between them; what a stage wrote for itself goes once its result is written."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        since = mark()
        docs = ws.table(stage(spark, docs, sf_dir), name)
        release(spark, since)
        if number:
            ws.drop(STAGES[number - 1][0])
    return docs
