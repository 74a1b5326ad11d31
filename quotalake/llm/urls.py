"""URL filter: host rules first, trust and distrust spread over the link graph for the rest.

Trust starts at hosts whose pages rules allow and follows links (personalised
PageRank); distrust starts at hosts whose pages rules block and follows links
backwards, to the hosts that point there.  Both are measured in pages, so a
host is blocked where more distrust than trust reaches it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import stored

DAMPING = 0.85
# Part of a host's own rank by which it may still grow in a round when the iteration has settled.
SETTLED = 1e-6
# Rules become one expression; more of them belong in a table.
MAX_RULES = 1_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and all its subdomains
    path: str  # fits paths that start with this

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path between the host and ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, or null; of equal ones block wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict, r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted over all whole pages; ``//host/x`` takes the page's scheme."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    return (pages.select(host_of(F.col("url")).alias("src"), links.alias("link"))
            .select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("weight")))


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) from ``seeds(host, trust, distrust)`` over ``links(src, dst, weight)``.

    Iterates ``rank = (1 - d) * seed + d * inflow`` until no host is new and
    no rank of a host grows by more than ``SETTLED`` of itself, however small
    it is, so how far a seed reaches does not depend on the other seeds.
    Ranks never shrink, so this ends; it takes the links of the longest chain
    to a new host and some 100 rounds.  Ranks are doubles in units of
    ``seeds``: 0 below 5e-324.  Rank that reaches a host without links is
    lost.  Every round is an equi-join and a partial aggregation and is
    stored in the shared checkpoint folder.
    """
    kinds = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    edges = links.select(kinds.alias("e"), "weight").select("e.*", "weight")
    out = edges.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    edges = stored(edges.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share")))
    base = stored(seeds.select(F.expr("stack(2, 'trust', host, trust, 'distrust', host, distrust) as (kind, a, seed)"))
                  .where("seed > 0").withColumn("seed", F.col("seed") * (1 - DAMPING)))
    rank = base.withColumnRenamed("seed", "rank")
    while True:
        inflow = (rank.join(edges, ["kind", "a"]).groupBy("kind", F.col("b").alias("a"))
                  .agg(F.sum(F.col("rank") * F.col("share") * DAMPING).alias("rank")))
        new = (inflow.unionByName(base.withColumnRenamed("seed", "rank"))
               .groupBy("kind", "a").agg(F.sum("rank").alias("rank")))
        step = stored(new.join(rank.withColumnRenamed("rank", "old"), ["kind", "a"], "left")
                      .select("kind", "a", "rank", (F.col("rank") - F.coalesce("old", F.lit(0.0))).alias("grown")))
        rank = step.select("kind", "a", "rank")
        if step.where(F.col("grown") > F.col("rank") * SETTLED).isEmpty():
            break
    return (rank.groupBy(F.col("a").alias("host"))
            .agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
                 F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust")))


def judge_urls(pages: DataFrame, rules: list[Rule], limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust_share for every row of ``pages(page_id, url, html)``.

    A page takes the verdict of the longest rule that fits its url; else its
    host is blocked where distrust is more than ``limit`` of all rank that
    reaches it, and allowed otherwise, also where no rank reaches it.  A null
    url or one without ``://`` has an empty host and path and is allowed
    unless a rule fits; null html has no links; repeated rows each give a row
    and count as pages of their own; other columns are ignored; an empty
    table gives no rows.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    seeds = (ruled.where("found is not null and host <> ''").groupBy("host")
             .agg(F.count_if(F.col("found.verdict") == "allow").alias("trust"),
                  F.count_if(F.col("found.verdict") == "block").alias("distrust")))
    seeds = seeds.select("host", F.col("trust").cast("double").alias("trust"), F.col("distrust").cast("double").alias("distrust"))
    ranks = spread(host_links(pages), seeds).select(
        F.col("host").alias("of"), F.expr("try_divide(distrust, trust + distrust)").alias("distrust_share"))
    blocked = F.coalesce(F.col("distrust_share") > limit + 1e-9, F.lit(False))
    return (ruled.join(ranks, F.col("host") == F.col("of"), "left")
            .select("page_id", "host", "path", F.col("found.name").alias("rule"),
                    F.coalesce("found.verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "distrust_share"))
