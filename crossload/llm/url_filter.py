"""URL filter: rules in a trie over reversed host labels, then path segments.

Rules are a parameter list of bounded size (MAX_RULES), so the trie is broadcast.
A rule fits its host and all subdomains when the url's path starts with the rule's
path. Precedence: more host labels, then the longer path; of equal rules, allow.

Null url, or one without ``://``: empty host and path, no rule, the default verdict.
Empty tables give empty results; repeated rows are judged alike; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

MAX_RULES = 1_000_000
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def build_trie(rules) -> dict:
    """Nodes are dicts: children by label, and under None the path trie's root.

    A path trie follows whole segments; what is left after the last slash is a
    prefix of the next segment, kept as (tail, rule, verdict) at the node.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules: too many to broadcast")
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(None, []).append((tail, host + path, verdict))
    return root


def judge(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The winning rule and its verdict, or (None, None)."""
    chain, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            chain.append(node[None])
    segments = path.split("/")
    for top in reversed(chain):
        best, node, depth = None, top, 0
        while node is not None:
            for tail, rule, verdict in node.get(None, ()):
                if depth < len(segments) and segments[depth].startswith(tail):
                    rank = (len(rule), verdict == "allow")
                    if best is None or rank > best[0]:
                        best = (rank, rule, verdict)
            # a segment is followed by a slash, so the last one is not whole
            node = node.get(segments[depth]) if depth < len(segments) - 1 else None
            depth += 1
        if best:
            return best[1], best[2]
    return None, None


def filter_urls(pages: DataFrame, rules=None, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (which replace columns of these names)."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(RULES if rules is None else rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [judge(trie.value, h, s) for h, s in zip(p["host"], p["path"])]
            yield pd.DataFrame(got, columns=["rule", "verdict"], dtype=object)

    # fixed pattern: the parts of a url after the first "://"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), pattern, k), F.lit(""))
    got = free(pages, "got")
    host = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        pages.withColumns({"host": host, "path": part(2)})
        .withColumn(got, decide(F.struct("host", "path")))
        .withColumns({"rule": F.col(got)["rule"], "verdict": F.coalesce(F.col(got)["verdict"], F.lit(default))})
        .drop(got)
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
