"""Inputs of the registered queries: the tables, and texts and tokens composed from them.

The tables hold invented prose without the words that the operators look for.
So each document is put whole between a heading and sections; the same SQL makes
it in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RESUME_SQL = """
SELECT doc_id, lang, source, CASE doc_id % 5
  WHEN 0 THEN 'Maria K. Lopez' || chr(10) || 'maria.lopez @ mail.example.com' || chr(10) || '+20 1055512345'
  WHEN 1 THEN 'JOHN SMITH' || chr(10) || 'reach jsmith example.org' || chr(10) || '(614) 555-0123'
  WHEN 2 THEN 'Senior Developer' || chr(10) || 'Ana Perez' || chr(10) || 'ana at example.net' || chr(10) || '010 5551 2345'
  WHEN 3 THEN 'RESUME' || chr(10) || 'Li Wei' || chr(10) || '1-614-555-0199'
  ELSE 'Acme Corp Columbus, OH' || chr(10) || 'Tom Oneil' || chr(10) || '43215 555.123.4567' END
  || chr(13) || chr(10) || 'Summary: builder of data systems' || chr(10) || coalesce(text, '') || chr(10)
  || 'Technical Skills: Python, PostgreSQL and Power BI' || chr(10) || 'dataa modeling, ci/cd, c' || chr(10)
  || 'Professional Experience' || chr(10) || 'Acme Corp' || chr(10) || '2003-2007 9 Columbus, OH' || chr(10) || 'Built pipelines in Spark' || chr(10) || 'Built  pipelines in spark' || chr(10)
  || 'Education' || chr(10) || '2019 - Present' || chr(10) || 'BSc Physics' || chr(10) || 'Ohio' || chr(10) || '2015 -' || chr(10) || 'High School' AS text
FROM {documents}
"""


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESUME_SQL, documents=table(spark, sf_dir, "documents"))


TOKENS_SQL = """
SELECT user_id AS doc_id, ts, event_id,
  CASE (event_id * 31 + user_id) % 8 WHEN 0 THEN 'B-SKILL' WHEN 1 THEN 'I-SKILL' WHEN 2 THEN 'B-NAME' WHEN 3 THEN 'I-NAME' WHEN 4 THEN 'I-SKILL' WHEN 5 THEN 'O' WHEN 6 THEN 'B-EXPERIENCE' ELSE 'I-EXPERIENCE' END AS entity,
  ((event_id * 37) % 97) / 100.0D AS score,
  CASE WHEN event_id % 5 = 0 THEN '##' WHEN event_id % 11 = 0 THEN '''' ELSE '' END || event_type AS word
FROM {events}
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens): tagged tokens of each user's events, in time order."""
    rows = spark.sql(TOKENS_SQL, events=table(spark, sf_dir, "events"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "entity", "score", "word")))
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda t: F.struct(t["entity"].alias("entity"), t["score"].cast("double").alias("score"), t["word"].alias("word"))).alias("tokens"))


#: Where the composed SQL differs in the checking engine.
def for_oracle(sql: str) -> str:
    return sql.replace("{documents}", "documents").replace("{events}", "events").replace("100.0D", "100.0::DOUBLE")
