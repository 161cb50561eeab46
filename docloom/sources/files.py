"""Sources and sinks: whole files, text, lists, JSON, overrides, reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import strip

TASK_SCHEMA = (
    "id long, data struct<text:string,meta:struct<filename:string,char_count:long>>, annotations array<struct<id:long,was_cancelled:boolean,"
    "result:array<struct<id:string,from_name:string,to_name:string,type:string,origin:string,value:struct<start:int,end:int,text:string,labels:array<string>>>>>>"
)
#: Plain values of the format that stand for numbers, booleans, nulls or collections.
_NO_STRING = re.compile(r"(?i)[-+]?(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:e[-+]?\d+)?|0x[0-9a-f]+|true|false|yes|no|on|off|null|~|[\[{].*")
NER_SCHEMA = "input_ids array<int>, attention_mask array<int>, labels array<int>, text string"


def read_binary(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content; content is read only if it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def inventory(files: DataFrame) -> DataFrame:
    """file_path, raw_label (the folder), file_name, size_bytes, is_empty of a listing (path, length); names end in .pdf in any case."""
    parts = F.split("path", "/")
    return files.filter(F.lower("path").endswith(".pdf")).select(
        F.col("path").alias("file_path"),
        F.element_at(parts, -2).alias("raw_label"),
        F.element_at(parts, -1).alias("file_name"),
        F.col("length").cast("long").alias("size_bytes"),
        (F.col("length") == 0).alias("is_empty"),
    )


def decoded(content: Column) -> Column:
    """Text of a file's bytes; line ends become \\n, bytes that are no UTF-8 go."""
    return F.replace(F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n"), F.lit("�"), F.lit(""))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name and text of each .txt file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), decoded(F.col("content")).alias("text"))


def listed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped lines that aren't blank."""
    return lines.select(strip(F.col(column)).alias("file_name")).filter("file_name <> ''")


def read_list(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The lines of a list; if the list is missing, the .txt files of a folder, where one is named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder is None or p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return listed(spark.read.text(path))
    return read_binary(spark, folder, "*.txt", recursive=False).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


def tasks_of(json: Column) -> Column:
    """Annotation tasks of a JSON array."""
    return F.from_json(json, f"array<struct<{_fields(TASK_SCHEMA)}>>")


def _fields(schema: str) -> str:
    """Top-level ``name type`` pairs as ``name:type``."""
    depth, out, named = 0, "", False
    for c in schema:
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == ",":
            named = False
        if depth == 0 and c == " " and not named and out and out[-1] not in ", ":
            c, named = ":", True
        out += "" if c == " " else c
    return out


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_SCHEMA).option("multiLine", True).json(path)


def read_ner_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NER_SCHEMA).option("multiLine", True).json(path)


def overrides_of(text: str | None) -> dict[str, str]:
    """Flat ``key: value`` lines (comments and quotes allowed): values in lower case with underscores. A nested value, or one that is no string, is an error."""
    out: dict[str, str] = {}
    for line in (text or "").splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        key, sep, value = body.partition(":")
        key, value = key.strip(), value.strip()
        if not sep or not value or body[0] in " \t-" or any(_NO_STRING.fullmatch(x) for x in (key, value)):
            raise ValueError(f"not a flat mapping of strings: {line!r}")
        key, value = key.strip("\"'"), value.strip("\"'")
        out[key] = value.lower().replace(" ", "_")
    return out


def ready_texts(ready: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of a list's files that aren't blank, and the list's files that have none."""
    names = ready.select("file_name").distinct()
    found = texts.filter(strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    return names.join(found, "file_name"), names.join(found.select("file_name"), "file_name", "left_anti")


def parse_documents(files: DataFrame, parsers: list[tuple[str, Callable[[bytes], str]]]) -> DataFrame:
    """path, text, parser, error: the first parser with 40 characters, else the longest text of the others in turn.

    ``parsers`` are (name, bytes -> text) in order; the last is the costly one
    and runs only if the text so far is weak. Failures end up in ``error``.
    """

    def parse(content: bytes) -> tuple[str | None, str | None, str | None]:
        if not content:
            return None, None, "Empty file content"
        text, used, failed = "", None, None
        for i, (name, parser) in enumerate(parsers):
            if len(text.strip()) >= 40:
                break
            try:
                got = parser(content) or ""
            except Exception as error:  # a broken file is a row, not a failed job
                failed = str(error)
                continue
            last = i == len(parsers) - 1
            if got and (used is None or last or len(got.strip()) > len(text.strip())):
                text, used = got, name
        return (text, used, None) if text.strip() else (None, None, failed or "No text found")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(bytes(c) if c is not None else b"") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [r[0] for r in rows], "parser": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, parser string, error string")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_by(df: DataFrame, path: str, column: str, form: str = "json") -> None:
    """One folder for each value of a column (verdicts, splits, batches)."""
    df.write.mode("overwrite").partitionBy(column).format(form).save(path)


def write_texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """One folder with one text file for each key: ``key=.../part-*.txt``, with a line end after the text."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_dataset(rows: DataFrame, tags: list[str], path: str, split: str = "split") -> None:
    """Rows of each split as JSON lines, and the label map (label to number and back) as one JSON file."""
    write_by(rows, f"{path}/rows", split)
    spark = rows.sparkSession
    table = spark.createDataFrame([(dict(enumerate(tags)), {t: i for i, t in enumerate(tags)})], "id2label map<int,string>, label2id map<string,int>")
    write_report(table, f"{path}/label_map")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)

