"""Secret scans with a trigram inverted index.

Each rule's regex gives a Boolean trigram query (``trigrams``). A block of texts
is indexed by the trigrams that the rules ask for, postings are intersected, and
only the candidates are searched with the regex. Rules without a mandatory
trigram scan every text. Blocks are bounded in bytes; one longer text is a block
by itself. There is no shuffle and no state between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, read, slices
from docloom.llm.trigrams import TrigramIndex, query_of, trigrams_of

BLOCK_BYTES = 4 << 20
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = bool
    ignore_case: bool = False


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 12


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 18


#: Kinds whose spans make up the base digest, in their order. Runs of 16 or more hexadecimal digits are matched as such: shorter runs would fail anyway.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", _long_key),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Spans that the base has not; publicly documented forms of keys.
MORE_RULES = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)), query_of(r.pattern)) for r in rules]
        self.wanted = set().union(*(trigrams_of(q) for _, _, q in self.rules))

    def block(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list]:
        """(start, order of the kind, end, kind) of each text, sorted."""
        index = TrigramIndex(data, offsets, self.wanted)
        out: list[list] = [[] for _ in texts]
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in index.candidates(query).tolist():
                out[i] += [(m.start(), order, m.end(), rule.kind) for m in regex.finditer(texts[i]) if rule.keep(m)]
        for found in out:
            found.sort()
        return out

    def scan(self, column: pa.Array) -> list[list]:
        """Spans of each text of a string column; nulls have none."""
        out = []
        column = column.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, side="right")) - 1)
            last = min(last, len(column))
            out += self.block(column.slice(first, last - first).to_pylist(), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            first = last
        return out


def scan_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive; by start, then by the rules' order).

    A row for each row. Null and empty texts have no spans. Repeated rows are
    scanned one by one, null ids are kept, other columns are not looked at.
    """

    bound_batches(docs.sparkSession)
    def scan(batches):
        scanner = Scanner(rules)
        for b in slices(batches, 1):
            spans = [[{"kind": k, "start": s, "end": e} for s, _, e, k in found] for found in scanner.scan(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}")


def masked(text: str, spans: list) -> str:
    """text with each run of overlapping spans replaced by ``[kind]`` of its first span."""
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col masked; all columns and rows stay.

    Null texts stay null and empty ones empty; repeated rows are masked alike.
    Columns of other names, whatever they are, pass through.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def redact(batches):
        scanner = Scanner(rules)
        for b in slices(batches, at):
            texts = b.column(at)
            found = scanner.scan(texts)
            if any(found):
                values = texts.to_pylist()
                texts = pa.array([masked(t, s) if s else t for t, s in zip(values, found)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(redact, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets of all documents as counts, a digest and a list of spans. Nulls, empty texts, repeats and empty tables as there."""
    base = [r.kind for r in BASE_RULES]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, base),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(base)), line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
