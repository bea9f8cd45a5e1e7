"""URL filters as a sort-merge range join.

A host is turned round (``www.example.com`` becomes ``com.example.www.``), so a
rule's host and all its subdomains form one interval of sorted keys, and the
intervals of different rules nest or are apart. Each task sorts its own pages by
that key and sweeps over them and the sorted rules once, keeping a stack of the
rules whose interval is still open; nothing is shuffled, so a hot host doesn't
matter. Rules are held in blocks of a bounded size: a list larger than one
block is swept block by block, and the longest match of all blocks wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Bytes of rules that one sweep holds in a task.
BLOCK_BYTES = 32 << 20
CONTRACT_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"(?s)^[^?#]*", 0)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Frame(NamedTuple):
    """The rules of one host: their sorted paths, and for each the nearest rule that is a prefix of it."""

    key: str
    paths: list[str]
    verdicts: list[str]
    parents: list[int]
    host: str

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        return at


def _frames(rules: list[tuple[str, str, str]]) -> list[_Frame]:
    by_host: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        paths = by_host.setdefault(host, {})
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict  # of two equal rules the stricter
    frames = []
    for host, paths in by_host.items():
        names, parents, open_ = sorted(paths), [], []
        for i, p in enumerate(names):
            while open_ and not p.startswith(names[open_[-1]]):
                open_.pop()
            parents.append(open_[-1] if open_ else -1)
            open_.append(i)
        frames.append(_Frame(".".join(reversed(host.split("."))) + ".", names, [paths[p] for p in names], parents, host))
    return sorted(frames, key=lambda f: f.key)


def _sweep(rules: list[tuple[str, str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, nxt, stack = _frames(rules), 0, []
        for pdf in batches:
            found, verdicts, hosts = [], [], []
            for key, path in zip(pdf["_key"], pdf["path"], strict=True):
                while nxt < len(frames) and frames[nxt].key <= key:
                    while stack and not frames[nxt].key.startswith(stack[-1].key):
                        stack.pop()
                    stack.append(frames[nxt])
                    nxt += 1
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                best, verdict, size = None, None, 0
                for f in stack:
                    if (at := f.longest(path)) >= 0 and (best is None or len(f.host) + len(f.paths[at]) >= len(best)):
                        best, verdict, size = f.host + f.paths[at], f.verdicts[at], len(f.host)
                found.append(best)
                verdicts.append(verdict)
                hosts.append(size)
            pdf["rule"], pdf["_verdict"] = pd.Series(found, dtype=object, index=pdf.index), pd.Series(verdicts, dtype=object, index=pdf.index)
            pdf["_size"] = pd.Series(hosts, dtype="int32", index=pdf.index)
            yield pdf

    return run


def _blocks(rules: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    """The rules, ``block_bytes`` at a time, each fetched from the cluster when its turn comes."""
    block, size = [], 0
    for r in rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").toLocalIterator():
        block.append((r["host"], r["path"], r["verdict"]))
        size += len(r["host"]) + len(r["path"]) + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of ``pages``; repeated rows stay repeated.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest (host and path together) wins, of equally long ones that with
    the longer host. No rule: ``default``. A null
    url, or one without ``://``, has an empty host and path, which no rule with
    a host fits. Rules with a null in them are passed over; of two rules with
    the same host and path the one that blocks counts. Urls are read whole,
    however long; an empty table gives no row, and without rules all are
    ``default``. Other columns of ``pages`` are left out, whatever their names.
    """
    host, path = url_parts(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_key", reversed_key(F.col("host")))
    out = out.withColumn("rule", F.lit(None).cast("string")).withColumn("_verdict", F.lit(None).cast("string")).withColumn("_size", F.lit(0))
    for block in _blocks(rules, block_bytes):
        before = out.withColumnsRenamed({"rule": "_rule0", "_verdict": "_verdict0", "_size": "_size0"})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in before.schema) + ", rule string, _verdict string, _size int"
        swept = before.sortWithinPartitions("_key").mapInPandas(_sweep(block), schema)
        better = F.col("_rule0").isNull() | (F.length("rule") > F.length("_rule0")) | ((F.length("rule") == F.length("_rule0")) & (F.col("_size") > F.col("_size0")))
        take = F.col("rule").isNotNull() & better
        out = swept.select(
            "page_id", "url", "host", "path", "_key", F.when(take, F.col("rule")).otherwise(F.col("_rule0")).alias("rule"), F.when(take, F.col("_verdict")).otherwise(F.col("_verdict0")).alias("_verdict"), F.when(take, F.col("_size")).otherwise(F.col("_size0")).alias("_size")
        )
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(CONTRACT_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM p),
u AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM q
), r(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id
"""
