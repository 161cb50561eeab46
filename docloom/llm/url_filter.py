"""URL rules by a sort-merge range join over reversed-host keys.

A host turned round label by label (``m.example.com`` -> ``com.example.m.``)
makes "this host and all its subdomains" one interval: every key that starts
with the rule's reversed host. Intervals of two rules are nested or disjoint.
So the keys of a batch are sorted, merged with the sorted rules, and the sweep
keeps a stack of the rules' hosts that enclose the current key. Each host on
the stack has its paths; a rule fits if the url's path starts with its path.
The longest rule (host and path together, then the host) wins.

Rules come to the tasks in broadcast blocks of ``RULES_PER_BLOCK`` raw rules; each
batch of pages is swept block by block, and only one block is prepared (turned into
intervals) at a time. The raw rules themselves, which the caller holds as a list,
stay in each worker. Pages are never shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, read

RULES_PER_BLOCK = 200_000

#: The rules of the production query: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT_VERDICT = "allow"


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class HostRules:
    """Rules of one host: by path, with the path lengths in descending order."""

    __slots__ = ("key", "lengths", "by_path")

    def __init__(self, key):
        self.key, self.by_path = key, {}

    def close(self):
        self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def longest(self, path: str):
        for n in self.lengths:
            if n <= len(path) and (found := self.by_path.get(path[:n])) is not None:
                return found
        return None


def prepared(rules) -> list[HostRules]:
    """Rules sorted by reversed host. Of rules with equal host and path the first stays."""
    by_key: dict[str, HostRules] = {}
    for verdict, host, path in rules:
        if not host:
            continue
        key = reversed_host(host)
        by_key.setdefault(key, HostRules(key)).by_path.setdefault(path, (len(host) + len(path), len(host), f"{host}{path}", verdict))
    for x in by_key.values():
        x.close()
    return sorted(by_key.values(), key=lambda x: x.key)


def sweep(hosts: list[str], paths: list[str], rules: list[HostRules]) -> list:
    """Best rule, or None, of each (host, path)."""
    keys = [reversed_host(h) for h in hosts]
    out: list = [None] * len(keys)
    stack: list[HostRules] = []
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while at < len(rules) and rules[at].key <= key:  # intervals that have begun
            while stack and not rules[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):  # intervals that have ended
            stack.pop()
        best = None
        for host in stack:
            found = host.longest(paths[i])
            if found is not None and (best is None or found[:2] > best[:2]):
                best = found
        out[i] = best
    return out


def parts(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, shape, 1)), F.regexp_extract(url, shape, 2)


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page id, host, path, rule and verdict of every row.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and get the default verdict. Repeated rows are judged one by one, null ids
    are kept, other columns are not looked at. Without rules every row gets the
    default; an empty table gives an empty result.
    """
    host, path = parts(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("rule_len"), F.lit(0).alias("host_len"))
    rules = sorted(rules, key=lambda r: reversed_host(r[1] or ""))
    blocks = [pages.sparkSession.sparkContext.broadcast(rules[i : i + RULES_PER_BLOCK]) for i in range(0, len(rules), RULES_PER_BLOCK)]

    def judge(batches):
        only = prepared(blocks[0].value) if len(blocks) == 1 else None
        for b in batches:
            page, host, path, *rest = b.columns
            rule, verdict, rl, hl = (c.to_pylist() for c in rest)
            hosts, paths = host.to_pylist(), path.to_pylist()
            for block in blocks:
                for i, best in enumerate(sweep(hosts, paths, only or prepared(block.value))):
                    if best is not None and best[:2] > (rl[i], hl[i]):
                        rl[i], hl[i], rule[i], verdict[i] = best
            yield pa.RecordBatch.from_arrays([page, host, path, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(rl, pa.int32()), pa.array(hl, pa.int32())], names=b.schema.names)

    return (out.mapInArrow(judge, out.schema) if blocks else out).select("page_id", "host", "path", "rule", "verdict")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls of all pages. Nulls, odd urls, repeats and empty tables as there."""
    return judge_urls(read(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT n, page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p LEFT JOIN r ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath)
  GROUP BY n, page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""
