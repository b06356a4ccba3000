"""URL filter: rules first, then trust that spreads over links between hosts.

Hosts with pages that a rule allows seed a personalised PageRank along links;
hosts with blocked pages seed one along reversed links, so that a host linking to
blocked ones is distrusted.  A host is blocked if its distrust exceeds its trust
times a threshold.  All steps are joins and sums over the host graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

DAMPING = 0.85
#: A step moves at most 2 * DAMPING**steps: 90 steps settle any graph, so more are an error.
MAX_STEPS = 100
TOLERANCE = 1e-6
#: Blocked when distrust > THRESHOLD * trust.
THRESHOLD = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*+=\s*+["']?((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """Fits urls of the host and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of equally long ones the first."""
    chosen = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from pages with host and html."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        pages.where(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(target).alias("dst"))
        .where((F.col("dst") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def personalised_rank(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, rank) from edges (src, dst, n) and seeds (host, weight); ranks sum to 1.

    Rank that reaches a host without links returns to the seeds.  Stops when a step
    moves less than TOLERANCE in all and reaches no new host, however long the
    chains; still moving more after MAX_STEPS is an error.  Each step is one join
    and one sum, written to the shared folder.  Without seeds: no rows.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    start = written(seeds.select("host", (F.col("weight") / F.lit(float(total))).alias("rank")))
    if edges.isEmpty():
        return start
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    rank, reached, step = start, start.count(), 0
    while True:
        moved = (
            rank.withColumnRenamed("host", "src")
            .join(shares, "src")
            .groupBy(F.col("dst").alias("host"))
            .agg((DAMPING * F.sum(F.col("rank") * F.col("share"))).alias("moved"))
        )
        moved = written(moved)
        kept = 1.0 - (moved.agg(F.sum("moved")).first()[0] or 0.0)
        new = written(
            moved.withColumnRenamed("moved", "rank")
            .unionByName(start.select("host", (F.col("rank") * F.lit(kept)).alias("rank")))
            .groupBy("host")
            .agg(F.sum("rank").alias("rank"))
        )
        both = new.select("host", F.col("rank").alias("d"), F.lit(1).alias("new")).unionByName(rank.select("host", (-F.col("rank")).alias("d"), F.lit(0).alias("new")))
        change, hosts = both.groupBy("host").agg(F.abs(F.sum("d")).alias("d"), F.max("new").alias("new")).agg(F.sum("d"), F.sum("new")).first()
        rank, step = new, step + 1
        if (change or 0.0) < TOLERANCE:
            if hosts == reached:
                return rank
        elif step >= MAX_STEPS:
            raise RuntimeError(f"ranks still move by {change} after {step} steps")
        reached = hosts


def host_scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of hosts with seeds or links, from pages with host, html and a rule verdict."""
    edges = written(host_edges(pages))
    seeds = pages.where((F.col("host") != "") & F.col("verdict").isNotNull()).groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    seeds = written(seeds)
    trust = personalised_rank(edges, seeds.where("good > 0").select("host", F.col("good").cast("double").alias("weight")))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(reverse, seeds.where("bad > 0").select("host", F.col("bad").cast("double").alias("weight")))
    return (
        trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, trust, distrust.

    Null urls and urls without "://" have an empty host and path; no rule fits
    them and no host speaks against them: allow.  Null html has no links.
    Repeated rows repeat (and count again as seeds and links); an empty table
    gives an empty result.  Other columns are not read.
    """
    parsed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    scores = written(host_scores(parsed.select("host", "html", F.col("fit.verdict").alias("verdict"))))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("distrust") > THRESHOLD * F.col("trust"), "block").otherwise("allow"))
    return (
        parsed.drop("html")
        .join(scores, "host", "left")
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )


def op6_hostgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url of pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
