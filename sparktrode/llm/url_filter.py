"""URL filters: rules by host and path, then trust and distrust spread over the host graph.

Trust is a personalised PageRank from trusted hosts along links; distrust is one from blocked
hosts against the links. A host is blocked where its distrust exceeds its trust. Host edges come
from absolute links in the pages, and from each host to its parent domain and back, as the pages
of many corpora hold relative links only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Steps of propagation go on until this share of a seed's score is still unspread, so no score is
#: further than that from its limit.
DAMPING, UNSPREAD = 0.85, 0.01
ITERATIONS = math.ceil(math.log(UNSPREAD) / math.log(DAMPING))
#: A host is a seed of distrust if rules block more than this share of its pages.
BLOCKED_SHARE = 0.5
PARENT_WEIGHT = 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal ones, the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, and each host with its parent domain.

    pages has host and html. Links are counted once a page; null html has none.
    """
    links = (
        pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
        .filter((F.col("host") != "") & (F.col("host") != F.col("dst")))
        .groupBy(F.col("host").alias("src"), "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    links = written(links, "host_links")  # the html is read once
    nodes = pages.select("host").filter("host <> ''").distinct().union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    up = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("src")).distinct()
    up = up.filter(F.instr("src", ".") > 0).withColumn("dst", F.expr("substring(src, instr(src, '.') + 1)")).withColumn("w", F.lit(PARENT_WEIGHT))
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(kind, host, score) after a fixed number of steps of personalised PageRank.

    seeds: (kind, host, score) with kind 'trust' or 'distrust', scores of a kind adding up to 1.
    Trust follows an edge, distrust goes against it. What reaches a host without edges stays there
    for that step and is not dealt on.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    step = written(both.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total")).alias("share")), "host_edges")
    scores = seeds = written(seeds, "host_seeds")
    for i in range(iterations):
        moved = scores.join(step, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        scores = moved.unionByName(seeds.select("kind", "host", ((1 - damping) * F.col("score")).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 4 == 3:
            scores = written(scores, "host_scores")
    return scores


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """A verdict for each page: the longest rule's, else its host's by trust and distrust.

    Null urls and urls without '://' have an empty host and path, fit no rule and are allowed, as
    is any host that neither kind of score reaches. Repeated rows are judged alike; null html has
    no links; other columns are not read. An empty table gives an empty result.
    """
    base = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    base = base.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    ruled = base.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "html", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled"))
    per_host = ruled.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    seeds = per_host.select(
        F.explode(
            F.array(
                F.struct(F.lit("trust").alias("kind"), F.when(F.col("allowed") > F.col("blocked"), F.col("allowed")).otherwise(0).alias("pages")),
                F.struct(F.lit("distrust").alias("kind"), F.when(F.col("blocked") > BLOCKED_SHARE * F.col("n"), F.col("blocked")).otherwise(0).alias("pages")),
            )
        ).alias("s"),
        "host",
    ).select("s.kind", "host", "s.pages").filter("pages > 0")
    totals = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    seeds = seeds.join(totals, "kind").select("kind", "host", (F.col("pages") / F.col("all")).alias("score"))
    scores = propagate(host_edges(ruled.select("host", "html")), seeds)
    by_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust")
    )
    blocked = written(by_host.filter("distrust > trust").select("host", F.lit(True).alias("bad")), "hosts_blocked")
    return ruled.drop("html").join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise("allow")).alias("verdict"))
