"""WARC archives with a two-level capture index.

Writing: every task writes archives of its own (one gzip member a record, so
each record can be read by its byte range) into a folder that all machines
share, under names that no other attempt uses. Only the names that a finished
task returns are ever indexed; what a lost attempt leaves is never read.

Index: lines keyed by the reversed-host form of the url and the page id, range
partitioned and sorted, packed into compressed blocks of ``BLOCK_LINES`` lines.
Each part keeps a sparse directory, with the first key of each block; the parts'
first keys are the level above, one row for a part.

Reading: keys are range partitioned and sorted too. A task binary-searches the
parts, the part's directory, then the block, and reads each record by its range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import read, slices, Workspace

BLOCK_LINES = 3000
ARCHIVE_BYTES = 1 << 30
GZIP_LEVEL = 3
CAPTURE_DATE = "2020-01-01T00:00:00Z"
#: Payload digests of at least 1/HOT_SHARE of all rows go to the tasks by broadcast (at most HOT_SHARE of them).
HOT_SHARE = 10_000

INDEX_SCHEMA = "key string, file string, offset long, length long"
PART_SCHEMA = "first_key string, file string, directory string, blocks int"
#: Bytes of records read at a time, but for a longer record.
READ_BYTES = 8 << 20
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """``http://m.Example.com/a?b`` -> ``com,example,m)/a?b``; white space and control bytes are quoted."""
    if url is None:
        return "-"
    _, sep, rest = url.partition("://")
    rest = rest if sep else url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return quote(",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:], safe="/?#=&,)(:;%@!$'*+~[]")


def index_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, size: int, digest: str, is_response: bool, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload if is_response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {CAPTURE_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/?#=&,)(:;%@!$*+~[]')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not is_response:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of RECORD_SCHEMA from a record; checks lengths and the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name][10:-1]) if fields.get(name, "<urn:page:>") != "<urn:page:>" else None
    length = int(fields["Content-Length"])
    body, end = rest[:length], rest[length:]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"]
    if end != b"\r\n\r\n" or kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def opened(uri: str):
    """File system and path of a URI in any store that pyarrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Archives:
    """Writes records one after the other; starts a new file at ARCHIVE_BYTES."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at = folder, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            store, path = opened(self.name)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = store.open_output_stream(path, compression=None)
        member = gzip.compress(data, GZIP_LEVEL, mtime=0)
        place = (self.name, self.at, len(member))
        self.out.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def kinds(ws: Workspace, pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, digest, and the id of the response (``keeper``) of rows whose payload repeats."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = ws.table(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "digests")
    total = pages.count()
    hot = digests.filter(F.col("n") * HOT_SHARE >= total).select("digest", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot"))
    cold = digests.filter(F.col("n") * HOT_SHARE < total).select(F.col("digest").alias("cold_digest"), F.col("keeper").alias("cold_keeper"), F.lit(True).alias("cold"))
    rows = pages.withColumn("digest", F.sha1(payload)).join(F.broadcast(hot), "digest", "left")
    # rows of hot digests are dealt by their id: the key below never occurs among the digests
    rows = rows.withColumn("cold_key", F.when(F.col("hot"), F.concat(F.lit("#"), F.coalesce(F.col("page_id"), F.lit(0)))).otherwise(F.col("digest")))
    rows = rows.join(cold, F.col("cold_key") == F.col("cold_digest"), "left")
    return rows.select("page_id", "url", "html", F.coalesce("hot_keeper", "cold_keeper").alias("keeper"), F.coalesce("hot", "cold", F.lit(False)).alias("repeats"))


def write_archives(ws: Workspace, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes page_id, url, html as records; returns the index lines (INDEX_SCHEMA), unsorted."""
    folder, rows = f"{ws.root}/archives", kinds(ws, pages, min_bytes)
    html = rows.columns.index("html")

    def write(batches):
        out = Archives(folder)
        try:
            for b in slices(batches, html):
                lines = []
                for r in b.to_pylist():
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    is_response = not r["repeats"] or r["page_id"] == r["keeper"]
                    data = record(r["page_id"], r["url"], payload, len(payload), base32_digest(payload), is_response, r["keeper"])
                    lines.append((index_key(r["url"], r["page_id"]), *out.add(data)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])
        finally:
            out.close()

    return ws.table(rows.mapInArrow(write, INDEX_SCHEMA), "lines")


def build_index(ws: Workspace, lines: DataFrame) -> DataFrame:
    """Sorts the lines into blocks; returns a row for each part (PART_SCHEMA)."""
    folder = f"{ws.root}/index"

    def pack(batches):
        store = out = None
        directory, block, at = [], [], 0
        name = f"{folder}/{uuid.uuid4().hex}"

        def flush():
            nonlocal at, block
            data = zlib.compress("\n".join(f"{k} {json.dumps([f, o, n])}" for k, f, o, n in block).encode(), GZIP_LEVEL)
            directory.append((block[0][0], at, len(data)))
            out.write(data)
            at, block = at + len(data), []

        for b in batches:
            for line in zip(*(b.column(i).to_pylist() for i in range(4))):
                if out is None:
                    store, path = opened(f"{name}.blocks")
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                block.append(line)
                if len(block) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        store, path = opened(f"{name}.directory")
        with store.open_output_stream(path, compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_pylist([{"first_key": directory[0][0], "file": f"{name}.blocks", "directory": f"{name}.directory", "blocks": len(directory)}], schema=pa.schema([("first_key", pa.string()), ("file", pa.string()), ("directory", pa.string()), ("blocks", pa.int32())]))

    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    return ws.table(lines.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(pack, PART_SCHEMA), "parts")


class Index:
    """Binary search over the parts, a part's directory, and a block. Holds one directory and one block at a time."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        self.parts = sorted(parts)
        self.first = [p[0] for p in self.parts]
        self.part = self.block = -1

    def _read(self, uri: str, offset: int, length: int) -> bytes:
        store, path = opened(uri)
        with store.open_input_file(path) as f:
            return f.read_at(length, offset) if length >= 0 else f.read()

    def _load_part(self, i: int) -> None:
        if i != self.part:
            self.directory = json.loads(zlib.decompress(self._read(self.parts[i][2], 0, -1)))
            self.block_keys = [d[0] for d in self.directory]
            self.part, self.block = i, -1

    def _load_block(self, i: int) -> None:
        if i != self.block:
            _, offset, length = self.directory[i]
            self.lines = zlib.decompress(self._read(self.parts[self.part][1], offset, length)).decode().split("\n")
            self.block = i

    def find(self, prefix: str) -> list[tuple[str, int, int]]:
        """Places of all records whose key starts with prefix, in key order."""
        out = []
        part = max(0, bisect.bisect_left(self.first, prefix) - 1)
        while part < len(self.parts):
            self._load_part(part)
            block = max(0, bisect.bisect_left(self.block_keys, prefix) - 1)
            while block < len(self.directory):
                self._load_block(block)
                i = bisect.bisect_left(self.lines, prefix)
                while i < len(self.lines) and self.lines[i].startswith(prefix):
                    out.append(tuple(json.loads(self.lines[i].split(" ", 2)[2])))
                    i += 1
                if i < len(self.lines):
                    return out
                block += 1
            part += 1
            if part < len(self.parts) and not (self.first[part] <= prefix or self.first[part].startswith(prefix)):
                return out
        return out


def read_ranges(places: list[tuple[str, int, int]]) -> dict:
    """Record data by (file, offset); opens each file once and reads forwards."""
    out, name, f = {}, None, None
    for file, offset, length in sorted(set(places)):
        if file != name:
            if f is not None:
                f.close()
            store, path = opened(file)
            name, f = file, store.open_input_file(path)
        out[file, offset] = gzip.decompress(f.read_at(length, offset))
    if f is not None:
        f.close()
    return out


def lookup(ws: Workspace, parts: DataFrame, keys: DataFrame, payload: bool = True) -> DataFrame:
    """RECORD_SCHEMA rows of all captures whose index key starts with a given key (column ``key``).

    A key is a full one (``index_key``), or ``surt(url) + " "`` for all captures
    of a url. Repeated keys are answered once. Without ``payload`` records are read and
    verified as ever, but the column stays null.
    """
    known = [tuple(r) for r in parts.select("first_key", "file", "directory").collect()]  # a row for each part

    def search(batches):
        index, before = Index(known), None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            places, size = [], 0
            for key in [*b.column(0).to_pylist(), None]:
                if key is not None and key != before:
                    found = index.find(key)
                    places += found
                    size += sum(p[2] for p in found)
                before = key if key is not None else before
                if places and (key is None or len(places) >= 256 or size >= READ_BYTES):
                    data = read_ranges(places)
                    records = [parse_record(data[p[:2]]) for p in places]
                    yield pa.RecordBatch.from_pylist(records if payload else [{**r, "payload": None} for r in records], schema=schema)
                    places, size = [], 0

    if not known:
        return ws.spark.createDataFrame([], RECORD_SCHEMA)
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(search, RECORD_SCHEMA)


def page_keys(pages: DataFrame) -> DataFrame:
    """Full index keys of pages."""

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index_key(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], names=["key"])

    return pages.select("page_id", "url").mapInArrow(keys, "key string")


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, payload: bool = True) -> DataFrame:
    """Writes every page, indexes the archives, and reads every record back by its key.

    A row for each row of pages. Null html is an empty payload; null urls have
    the key ``-``; null ids stay null. Of equal payloads of at least
    ``min_bytes`` bytes the largest page id is the response (repeated rows of
    that id are responses too; if all ids are null, all are responses). Other
    columns are not looked at. An empty table gives an empty result.
    """
    ws = Workspace(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parts = build_index(ws, write_archives(ws, pages, min_bytes))
    return lookup(ws, parts, page_keys(pages), payload)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_round_trip of all pages, without the payloads themselves. Nulls, repeats and empty tables as there."""
    return archive_round_trip(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
d AS (
  SELECT p.page_id, strlen(payload) AS payload_bytes, keeper,
    list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 6), lambda j: (instr('0123456789abcdef', substr(p.h, (i * 5 + j)::INT, 1)) - 1) * (16 ** (5 - j))::BIGINT))::BIGINT) AS v
  FROM p JOIN k USING (h))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[(i // 4 + 1)::INT] // (32 ** (3 - i % 4))::BIGINT) % 32) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
