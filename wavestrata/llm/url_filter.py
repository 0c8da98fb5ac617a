"""URL filters: rules indexed by their rarest literal token.

A rule is ``action host/path``: it fits the host and all its subdomains if the url's path starts with
the rule's path; ``*`` in either part stands for any characters (none of them ``/`` in a host). Among
fitting rules the longest wins, then the one with the longer host, then the earlier one.

A rule becomes a regular expression over host and path, and a set of literal tokens that each
fitting url must contain whole: the labels of its host and the full segments of its path. The
tokens of the rules are counted over all urls, and each rule is indexed under the one that
occurs least. A url's tokens fetch candidates, and only those run their regular expressions. Rules
without a whole literal token are candidates for every url.

The rules are a parameter and travel with the tasks; urls are never shuffled.

Rows: a null url or one without ``://`` has an empty host and path and fits no rule with a host; a
url that no rule fits gets the default verdict and a null rule. Other columns stay; host, path, rule and verdict
replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.pattern.partition("/")
        return host.translate(_LOWER), slash + path

    def expression(self) -> re.Pattern[str]:
        host, path = self.parts
        words = ["[^/]*".join(map(re.escape, host.split("*"))), ".*".join(map(re.escape, path.split("*")))]
        return re.compile(rf"(?:[^/]*\.)?{words[0]}{words[1] or '(?:/|$)'}" if host else rf"[^/]*{words[1]}", re.S)

    def tokens(self) -> set[str]:
        """Host labels and whole path segments; the text after the last slash may go on in the url."""
        host, path = self.parts
        return {f".{x}" for x in host.split(".") if x and "*" not in x} | {f"/{x}" for x in path.split("/")[1:-1] if x and "*" not in x}


def host_and_path(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def url_tokens(host: str, path: str) -> set[str]:
    return {f".{x}" for x in host.split(".")} | {f"/{x}" for x in path.split("/")[1:]}


def token_counts(urls: DataFrame, column: str, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs; tokens of no rule are not kept."""
    wanted = frozenset(t for r in rules for t in r.tokens())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in url_tokens(*host_and_path(url)) & wanted:
                    seen[t] = seen.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    sums = urls.select(column).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in sums.collect()}  # one row a rule token at most


class RuleIndex:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.rules = [(r.pattern, r.action, r.expression(), (len(r.pattern), len(r.parts[0]), -k)) for k, r in enumerate(rules)]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, r in enumerate(rules):
            tokens = sorted(r.tokens(), key=lambda t: (counts.get(t, 0), t))
            (self.by_token.setdefault(tokens[0], []) if tokens else self.always).append(k)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """Pattern and action of the winning rule."""
        found = [*self.always, *(k for t in url_tokens(host, path) & self.by_token.keys() for k in self.by_token[t])]
        fits = [self.rules[k] for k in found if self.rules[k][2].match(host + path)]
        return max(fits, key=lambda r: r[3])[:2] if fits else None


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", column: str = "url") -> DataFrame:
    rules = [Rule(*r) for r in rules]
    counts = token_counts(pages, column, rules)
    added = ["host", "path", "rule", "verdict"]
    kept = [f for f in pages.schema.fields if f.name not in added]
    names = [f.name for f in kept]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = []
            for url in batch.column(batch.num_columns - 1).to_pylist():
                host, path = host_and_path(url)
                rows.append((host, path, *(index.judge(host, path) or (None, default))))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, *added])

    source = pages.select(*names, F.col(column).alias("__url"))
    return source.mapInArrow(judge, T.StructType([*kept, *(T.StructField(x, T.StringType()) for x in added)]))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.page_id, p.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.url)
SELECT p.page_id, p.host, p.path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.url IS NOT DISTINCT FROM f.url
"""
