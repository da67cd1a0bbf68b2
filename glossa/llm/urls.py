"""URL filter: a trie over reversed host labels and path segments.

The rules are given to the operator, cut into tries of at most
``max_rules`` entries; each trie is shipped with the tasks, so what is sent at
once has a fixed bound, and a longer rule list takes more than one pass.

The longest rule is the one of most characters, host and path together, and not
the one of the deepest host.

Defined cases: a null or empty url or one without ``://`` has empty host and path
and gets the default verdict; of rules that fit and are equally long one that
blocks wins, then the one that sorts last; a null id is kept; a very long url is
read whole; repeated rows are judged one by one; an empty table gives none; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: the rules of the contract
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

MAX_RULES = 200_000


class Trie:
    """Host labels from the last to the first, then path segments.

    A rule's last path segment is a prefix of the url's segment, so it is kept
    apart from the whole segments before it.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.root: dict = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(lower_ascii(host).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            if not slash:
                keep(node, "", verdict, rule)
                continue
            *whole, last = rest.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            keep(node, last, verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        segments = path[1:].split("/") if path.startswith("/") else []
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            fits = [node["leaves"][""]] if "" in node.get("leaves", {}) else []
            at = node.get("paths")
            for segment in segments:
                if at is None:
                    break
                fits += [at["leaves"][segment[:n]] for n in at.get("lengths", ()) if n <= len(segment) and segment[:n] in at["leaves"]]
                at = at.get("next", {}).get(segment)
            best = max((x for x in (best, *fits) if x), key=rank, default=None)
        return best


def rank(hit: tuple[str, str]) -> tuple:
    """Longer rules go first, of equally long ones those that block, then the one that sorts last."""
    rule, verdict = hit
    return len(rule), verdict == "block", rule


def keep(node: dict, last: str, verdict: str, rule: str) -> None:
    leaves = node.setdefault("leaves", {})
    if leaves.get(last, ("", "allow"))[1] != "block":
        leaves[last] = (rule, verdict)
    node["lengths"] = sorted({len(x) for x in leaves})


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """One row per page: id, host, path, rule (null: none fits) and verdict."""
    kind = pages.schema[id_col].dataType.simpleString()
    df = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("best"))
    for i in range(0, max(1, len(rules)), max_rules):
        trie = Trie(rules[i : i + max_rules])

        def run(batches: Iterator[pa.RecordBatch], trie: Trie = trie) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
                olds = [x and (x["rule"], x["verdict"]) for x in batch.column("best").to_pylist()]
                hits = [max((x for x in (old, trie.find(*p)) if x), key=rank, default=None) for old, p in zip(olds, parts, strict=True)]
                best = pa.array([x and dict(zip(("rule", "verdict"), x, strict=True)) for x in hits], pa.struct([("rule", pa.string()), ("verdict", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), best, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())], names=["id", "url", "best", "host", "path"])

        df = df.select("id", "url", "best").mapInArrow(run, f"id {kind}, url string, best struct<rule:string,verdict:string>, host string, path string")
    return df.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, rhost, rpath, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
