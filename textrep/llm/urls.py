"""URL filters: a trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, ship, shipped, struct_of

#: Rules sent to the tasks as a trie; a longer list is joined instead.
MOST_RULE_BYTES = 32 << 20


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
DEFAULT = "allow"

JUDGED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


class Node:
    """A host label or a path segment; ``rule`` ends here, ``heads`` are rules that end within the next segment."""

    __slots__ = ("labels", "segments", "rule", "heads")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.rule: Rule | None = None
        self.heads: dict[str, Rule] = {}


def build(rules: Iterable[Rule]) -> Node:
    """A rule's path is a prefix: its whole segments are nodes, what follows the last ``/`` is a head."""
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, head = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if head:
            node.heads[head] = rule
        else:
            node.rule = rule
    return root


def longest(root: Node, host: str, path: str) -> Rule | None:
    """The rule that fits with the most host labels, then with the longest path."""
    chain, node = [], root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        chain.append(node)
    segments = path.split("/")
    for node in reversed(chain):
        best = node.rule
        for i, segment in enumerate(segments):
            if node.heads:
                fits = [head for head in node.heads if "/".join(segments[i:]).startswith(head)]
                best = node.heads[max(fits, key=len)] if fits else best
            node = node.segments.get(segment) if i < len(segments) - 1 else None
            if node is None:
                break
            best = node.rule or best
        if best:
            return best
    return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between ``://`` and the next ``/``, ``?`` or ``#`` with A-Z in lower case, and the path; else both empty."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge(
    pages: DataFrame,
    rules: Iterable[Rule] = RULES,
    default: str = DEFAULT,
    key: str = "page_id",
    url: str = "url",
    most_bytes: int = MOST_RULE_BYTES,
) -> DataFrame:
    """``(key, host, path, rule, verdict)`` for each row of ``pages``.

    A null or empty url, or one without ``://``, has an empty host and path,
    fits no rule and gets ``default``; null keys and repeated rows stay as they
    are. Of two rules with the same host and path the last one holds.
    """
    rules = list({r.name: r for r in rules}.values())
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    if sum(len(r.name.encode()) + 200 for r in rules) > most_bytes:
        return _joined(base, rules, default).withColumnRenamed("_key", key)
    sent = ship(pages, rules)

    def start():
        root = build(shipped(sent))

        def work(part: pa.RecordBatch) -> pa.Array:
            hits = [longest(root, h, p) if h else None for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist())]
            return struct_of(
                rule=pa.array([r.name if r else None for r in hits], pa.string()),
                verdict=pa.array([r.verdict if r else default for r in hits], pa.string()),
            )

        return work

    out = annotate(base, "path", "_judged", JUDGED, start)
    return out.select(F.col("_key").alias(key), "host", "path", "_judged.rule", "_judged.verdict")


def _joined(base: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same without the trie: each distinct host and path meets the rules of each of its host suffixes."""
    spark = base.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.", -1)
    pairs = base.where("host <> ''").select("host", "path").distinct()
    suffixes = pairs.withColumn("labels", labels).select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("rule_host")
    )
    fits = suffixes.join(table, "rule_host").where("startswith(path, rule_path)")
    rank = F.struct(F.size(F.split("rule_host", r"\.", -1)), F.length("rule_path"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    return base.join(best, ["host", "path"], "left").select(
        "_key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def rules_of(lines: Iterable[str]) -> Iterator[Rule]:
    """Rules from lines such as ``block example.com/de/``."""
    for line in lines:
        verdict, _, name = line.strip().partition(" ")
        host, slash, path = name.strip().partition("/")
        if verdict in ("allow", "block") and host:
            yield Rule(host, slash + path if slash else "/", verdict)
