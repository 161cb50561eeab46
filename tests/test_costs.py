"""Queries take few times as long as a fixed plain expression on the same texts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.plans.queries import QUERIES

#: Query and the most that it may take, in the time of the plain expression.
COSTS = {
    "first_phone": 2,
    "quality_score": 6,
    "verdict_counts": 4,
    "name_score": 3.7,
    "best_name": 2.5,
    "experience_filter": 3.8,
    "section_dedupe": 3,
    "education_filter": 2.4,
    "tag_histogram": 8,
    "skills_exact": 3,
    "skills": 6,
    "name_candidates": 2.5,
    "debug_view": 5,
    "first_span": 3,
    "profile": 15,
    "response_json": 15,
    "hybrid_merge": 15,
    "prelabel": 45,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents of 4 MB in lines of 30 words, and a few events."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxzé", k=rng.randrange(1, 12))) for _ in range(5000)]
    line = lambda: " ".join(rng.choices(vocabulary, k=30)).capitalize() + "."
    rows = [(i, "\n".join(line() for _ in range(12)), "en", "src1") for i in range(1800)]
    d = str(tmp_path_factory.mktemp("costs"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(4).write.parquet(f"{d}/documents.parquet")
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{d}/events.parquet")
    return d


def seconds(df) -> float:
    """The better of two runs after one."""
    took = []
    for _ in range(3):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took[1:])


@pytest.fixture(scope="module")
def plain(spark, folder):
    text = F.regexp_replace(F.regexp_replace("text", "[aeiou]+", "_"), r"[\p{L}]+", "w")
    return seconds(spark.read.parquet(f"{folder}/documents.parquet").select(F.size(F.split(text, " "))))


@pytest.mark.parametrize("name", COSTS)
def test_costs(spark, folder, plain, name):
    assert seconds(QUERIES[name](spark, folder)) < COSTS[name] * plain
