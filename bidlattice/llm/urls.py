"""URL filter: allow and block entries in a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The entries that op7's contract fixes.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nodes {"next": labels, "paths": node}; a path node is {"next": whole segments, "ends":
    {segment start: rule}, "longest": length of the longest start}.

    Of two entries for the same host and path, block wins.
    """
    root: dict = {"next": {}, "paths": None}
    for rule in rules:
        node = root
        for label in reversed(rule.host.lower().split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        node["paths"] = node["paths"] or {"next": {}, "ends": {}, "longest": 0}
        node = node["paths"]
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "ends": {}, "longest": 0})
        node["longest"] = max(node["longest"], len(last))
        old = node["ends"].get(last)
        if old is None or rule.verdict == "block":
            node["ends"][last] = (rule.name, rule.verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The name and verdict of the longest entry that fits; ties between lengths go to block."""
    best: tuple[int, bool, str, str] | None = None
    segments, node = path.split("/"), trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        at = node["paths"]
        for segment in segments:
            if at is None:
                break
            for size in range(min(len(segment), at["longest"]) + 1):
                if hit := at["ends"].get(segment[:size]):
                    name, verdict = hit
                    best = max(best or (-1,), (len(name), verdict == "block", name, verdict))
            at = at["next"].get(segment)
    return best and best[2:]


def _judge(trie, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_match(trie.value, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page_id", "host", "path")]
                + [pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages, which needs page_id and url.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or
    the end. A url that is null or has no `://` has both empty, fits no rule and gets the default. The trie is as
    large as the rule list, which the caller holds on the driver; no shuffle is needed. Repeated rows stay.
    """
    rules = list(rules)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    host = F.regexp_extract("url", r"://([^/?#]*)([^?#]*)", 1)
    split = pages.select(
        "page_id",
        F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", r"://([^/?#]*)([^?#]*)", 2), F.lit("")).alias("path"),
    )
    return split.mapInArrow(_judge(trie, default), "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS h,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
    ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT v.page_id, v.host, v.path, rhost || rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY v.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
      FROM v LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
