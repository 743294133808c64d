"""URL filters: a sort-merge range join of pages with host and path rules.

A host's canonical key is its labels in reverse order, each followed by a dot, so a rule's host
and all subdomains are one interval of keys.  Each partition sorts its pages by key and sweeps
them together with the rules sorted by interval start; a stack holds the rules whose interval
is open (intervals nest, they never cross).  An open host answers with the longest of its path
prefixes that the page's path begins with; of all open hosts the longest rule in total wins.

Rules travel in pieces of at most ``PIECE`` rules; further pieces are further sweeps that keep
the longer rule, so any number of rules is exact.  Pages are not moved by host: a host with a
third of all pages stays dealt over its input partitions.

Defined results: a null url or one without ``://`` has an empty host and path and gets the
default verdict; very long urls are read whole; repeated rows and rows without an id are judged
each; an empty table yields no rows; further columns, whatever their names, are ignored.  Rules
with equal host and path: the first wins.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import table

#: The rules of the registered query (host, path prefix, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
PIECE = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(host: str) -> str:
    return "".join(x + "." for x in reversed(host.split(".")))


def intervals(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, int, dict[str, str], list[int]]]:
    """One entry per host, by interval start: start, end, host length, verdict by path, path lengths."""
    hosts: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        hosts.setdefault(host, {}).setdefault(path, verdict)
    return sorted((canonical(h), canonical(h)[:-1] + "/", h, p, sorted({len(x) for x in p}, reverse=True)) for h, p in hosts.items())


def _sweep(batches, rules):
    entries = rules.value
    nxt, stack = 0, []
    for batch in batches:
        keys, paths = batch.column("key").to_pylist(), batch.column("path").to_pylist()
        size, rule, verdict = (batch.column(c).to_pylist() for c in ("size", "rule", "verdict"))
        for k, (key, path) in enumerate(zip(keys, paths, strict=True)):
            while nxt < len(entries) and entries[nxt][0] <= key:
                while stack and stack[-1][1] <= entries[nxt][0]:
                    stack.pop()
                stack.append(entries[nxt])
                nxt += 1
            while stack and stack[-1][1] <= key:
                stack.pop()
            for _, _, host, by_path, lengths in stack:
                for n in lengths:
                    found = by_path.get(path[:n]) if len(path) >= n else None
                    if found is not None:
                        if len(host) + n > size[k]:
                            size[k], rule[k], verdict[k] = len(host) + n, host + path[:n], found
                        break
        kept = [batch.column(c) for c in ("page_id", "host", "path", "key")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(size, pa.int32()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "key", "size", "rule", "verdict"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page."""
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    base = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    base = base.withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    base = base.select("page_id", F.translate("host", _UPPER, _LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), "^[^?#]*", 0).alias("path"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    out = base.withColumns({"key": key, "size": F.lit(-1), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    kind = pages.schema["page_id"].dataType.simpleString()
    out = out.sortWithinPartitions("key")
    for at in range(0, len(rules), PIECE):
        shared = pages.sparkSession.sparkContext.broadcast(intervals(rules[at : at + PIECE]))
        out = out.mapInArrow(partial(_sweep, rules=shared), f"page_id {kind}, host string, path string, key string, size int, rule string, verdict string")
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = """
WITH r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM a),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
j AS (SELECT p.page_id, p.host, p.path, rh || rp AS rule, rv FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)),
w AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv FROM j GROUP BY ALL)
SELECT p.page_id, p.host, p.path, w.rule, coalesce(w.rv, 'allow') AS verdict FROM p LEFT JOIN w USING (page_id, host, path)
"""
