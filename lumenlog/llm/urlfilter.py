"""URL filters (operator 7): a trie over reversed host labels and path segments.

Rules fit a host and its subdomains, and paths that start with the rule's. The rule with the most host labels wins,
then the longest path; of two equal rules block wins. The trie of up to MAX_RULES rules is sent to the tasks; beyond
that the url's own host suffixes and path prefixes are joined with the rules table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the trie sent to the tasks, each of at most MAX_RULE_CHARS characters: at most about 200 MB.
MAX_RULES, MAX_RULE_CHARS = 200_000, 1000
SCHEMA = "host string, path string, verdict string"


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with host and path (both empty for a null url or one without ://)."""
    get = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return df.withColumn("host", F.translate(get(1), UPPER, LOWER)).withColumn("path", get(2))


class Trie:
    """Nodes are dicts: a label or segment leads to a node; under 0 a host node has its path trie; under 1 a path
    node has [(rest of the path, rule number)], longest first."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        self.rules = rules
        lists = []
        for k, (host, path, verdict) in enumerate(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(0, {})
            *full, rest = path.split("/")
            for seg in full:
                node = node.setdefault(seg, {})
            if 1 not in node:
                lists.append(node.setdefault(1, []))
            node[1].append((rest, verdict == "block", k))
        for ends in lists:
            ends.sort(key=lambda e: (-len(e[0]), not e[1]))

    def match(self, host: str, path: str) -> int:
        """The number of the winning rule, or -1."""
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if 0 in node:
                hosts.append(node[0])
        segs = path.split("/")
        for node in reversed(hosts):
            best = -1
            for k, seg in enumerate(segs):
                best = next((r for rest, _, r in node.get(1, ()) if seg.startswith(rest) or rest == "" and k == len(segs) - 1), best)
                node = node.get(seg) if k + 1 < len(segs) else None
                if node is None:
                    break
            if best >= 0:
                return best
        return -1


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule (host and path of the winning rule, null if none fits) and verdict (`default`
    without a rule); columns of these names are replaced. `rules`: (host, path, verdict), as a list or a DataFrame; a
    rule without a host, path or verdict fits nothing. A null or empty url, and one without ://, has an empty host and
    path. Urls may be of any length; repeated rows stay; an empty table gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("host", "path", "rule", "verdict")
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").na.drop()
        longest = rules.agg(F.count("*"), F.max(F.length("host") + F.length("path"))).first()
        if longest[0] > MAX_RULES or (longest[1] or 0) > MAX_RULE_CHARS:
            return _joined(df, rules, url, default)
        rules = [(r.host, r.path, r.verdict) for r in rules.collect()]
    else:
        rules = [r for r in rules if None not in r]
        if len(rules) > MAX_RULES or any(len(h) + len(p) > MAX_RULE_CHARS for h, p, _ in rules):
            return _joined(df, spark.createDataFrame(rules, SCHEMA), url, default)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def winner(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match, own = trie.value.match, trie.value.rules
        won = [own[k] if (k := match(h, p)) >= 0 else None for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": pd.Series([w and w[0] + w[1] for w in won], dtype=object), "verdict": pd.Series([w[2] if w else default for w in won], dtype=object)})

    out = url_parts(df, url).withColumn("winner", winner("host", "path"))
    return out.withColumn("rule", F.col("winner.rule")).withColumn("verdict", F.col("winner.verdict")).drop("winner")


def _joined(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The same by joins: distinct (host, path) pairs meet the rules under their host suffixes and path prefixes
    that end at a slash; what follows a rule's last slash is compared after the join."""
    both = url_parts(df, url)
    labels, segs = F.split("host", r"\."), F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix = F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.array_join(F.slice(segs, 1, i), "/"))
    keys = both.select("host", "path").distinct().withColumn("h", F.explode(suffix)).withColumn("p", F.explode(prefix))
    base = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    own = rules.select(F.col("host").alias("h"), base.alias("p"), F.col("path").alias("rule_path"), F.col("verdict").alias("v")).distinct()
    order = W.partitionBy("host", "path").orderBy(F.size(F.split("h", r"\.")).desc(), F.length("rule_path").desc(), F.col("v").desc())
    best = keys.join(own, ["h", "p"]).where(F.col("path").startswith(F.col("rule_path"))).withColumn("k", F.row_number().over(order)).where("k = 1")
    out = both.join(best.select("host", "path", F.concat("h", "rule_path").alias("rule"), F.col("v").alias("verdict")), ["host", "path"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*df.columns, "host", "path", "rule", "verdict")
