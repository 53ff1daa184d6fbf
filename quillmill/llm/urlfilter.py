"""URL filters by a sort-merge range join.

A host becomes its labels in reverse order, each closed by a mark, so that a host and all
its subdomains are one interval of the sorted keys, and intervals nest or are apart. URLs
are dealt by key ranges; a rule goes to each range that its interval meets; within a range
both sides are swept in key order with a stack of the rules whose intervals are open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MARK = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
    from there up to `?`, `#` or the end. Null, or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), MARK), F.lit(MARK)))


def _sweep(urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """The longest fitting rule of each (host, path) of one key range."""
    nodes: dict[str, tuple[str, str, dict[str, str], list[int]]] = {}
    for key, host, path, verdict in rules[["key", "rule_host", "rule_path", "verdict"]].itertuples(index=False):
        paths = nodes.setdefault(key, (key, host, {}, []))[2]
        paths[path] = max(verdict, paths.get(path, ""))  # "block" over "allow"
    for _, _, paths, lengths in nodes.values():
        lengths += sorted({len(p) for p in paths}, reverse=True)
    ordered, at, stack = sorted(nodes), 0, []
    urls = urls.sort_values("key", kind="stable")
    found = []
    for key, host, path in urls[["key", "host", "path"]].itertuples(index=False):
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while at < len(ordered) and ordered[at] <= key:
            if key.startswith(ordered[at]):
                stack.append(nodes[ordered[at]])
            at += 1
        best, size = (None, None), -1
        for _, rule_host, paths, lengths in stack:
            if host != rule_host and not host.endswith("." + rule_host):
                continue
            for n in lengths:
                if path[:n] in paths and n <= len(path):
                    if len(rule_host) + n >= size:
                        best, size = (rule_host + path[:n], paths[path[:n]]), len(rule_host) + n
                    break
        found.append(best)
    return pd.DataFrame({"host": urls["host"], "path": urls["path"], "rule": [r for r, _ in found], "verdict": [v for _, v in found]})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url).

    rules(host, path, verdict): a rule fits its host and all subdomains if the path of
    the URL starts with the rule's; the longest host + path wins, the longer host of two
    as long. Rules without a host never fit; a null path is empty; of rules with equal
    host and path `block` holds. No rule fits: rule is null and verdict is `default`.
    Repeated URLs are judged once and joined back, so one URL in a third of all rows is
    one row of the sweep. An empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    urls = store.written(
        urls.repartitionByRange("key", "path").withColumn("part", F.spark_partition_id()), "urls"
    )
    # one row a range: as many as shuffle partitions, whatever the number of URLs
    ranges = urls.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect()
    parts, lows, highs = ([r[c] for r in ranges] for c in ("part", "low", "high"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rule in batches:
            first = [bisect_left(highs, k) for k in rule["key"]]
            end = [bisect_right(lows, k + "\U0010ffff") for k in rule["key"]]
            rule["part"] = [parts[a:b] for a, b in zip(first, end)]
            rule = rule.explode("part").dropna(subset=["part"])
            yield rule.astype({"part": "int32"})

    own = rules.select(
        F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("rule_host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("rule_path"),
        F.col("verdict").cast("string").alias("verdict"),
    ).where("rule_host <> '' and verdict is not null")
    own = own.withColumn("key", host_key(F.col("rule_host")))
    own = own.mapInPandas(spread, "rule_host string, rule_path string, verdict string, key string, part int")
    judged = urls.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(
        _sweep, "host string, path string, rule string, verdict string"
    )
    fits = judged.where("rule is not null")
    out = rows.join(fits, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
