"""URL rules and link-graph propagation of trust and distrust.

Rules decide what they fit. Hosts whose pages rules allow are trusted seeds and
those that rules block are blocked seeds. Personalised PageRank carries trust
along the host edges from the trusted seeds, and distrust against them from
the blocked ones (who links to a blocked host is suspect). Pages that no rule
fits are blocked if their host's distrust outweighs its trust by ``RATIO`` and is above
``FLOOR`` times the mean; those of the seeds' hosts too.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule and is allowed; a null html has no links; links to the own host and
relative ones make no edge; repeated rows are judged alike; an empty table gives
an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, RATIO, FLOOR = 0.85, 2.0, 2.0
#: Rounds between two looks at whether scores still move, and by how much in all they may; as each round takes DAMPING of what is left, that is soon.
ROUNDS, STILL = 8, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, weight): links from pages of one host to another, combined map-side."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(https?://[^\"'\\s>]+)"), 1)
    dst = host_of(F.col("url_"))
    return pages.select(F.col(host).alias("src"), F.explode(links).alias("url_")).select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, reverse: bool = False, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank (host, score) from ``seeds`` (host, mass) along (or against) ``edges``; scores sum to 1.

    Each round joins scores to edges by their source and sums by target; the
    sums are combined map-side, so a host with many links is not gathered. Rounds go on until scores move no more.
    Mass at hosts without links out goes back to the seeds: that only scales the scores.
    """
    if reverse:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    out = edges.groupBy("src").agg(F.sum("weight").alias("all_"))
    share = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all_")).alias("p")), "share")
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score"))
    start = written(seeds.select("host", (F.col("mass") / total).alias("mass")), "seeds")
    score = start.select("host", F.col("mass").alias("score"))
    if share.isEmpty():
        return score
    moving = 1.0
    while moving > STILL:
        old = score
        for _ in range(ROUNDS):
            moved = score.join(share, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
            score = moved.unionByName(start.select("host", (F.col("mass") * (1 - damping)).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        score = written(score, "rank")
        both = score.unionByName(old.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.sum("score").alias("by"))
        moving = both.agg(F.sum(F.abs("by"))).first()[0]
    whole = score.agg(F.sum("score")).first()[0]
    return score.select("host", (F.col("score") / whole).alias("score"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    edges = written(host_edges(pages.select(host.alias("host"), "html")), "edges")
    seeds = written(base.where("by_rule is not null and host <> ''").groupBy("host", "by_rule").agg(F.count("*").cast("double").alias("mass")), "hosts")
    trust = propagate(edges, seeds.where("by_rule = 'allow'").select("host", F.log1p("mass").alias("mass")))
    doubt = propagate(edges, seeds.where("by_rule = 'block'").select("host", F.log1p("mass").alias("mass")), reverse=True)
    both = trust.select("host", F.col("score").alias("trust")).join(doubt.select("host", F.col("score").alias("doubt")), "host", "full")
    both = written(both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("doubt", F.lit(0.0)).alias("doubt")), "scores")
    mean = both.agg(F.avg("doubt")).first()[0] or 0.0
    bad = both.where((F.col("doubt") > RATIO * F.col("trust")) & (F.col("doubt") > FLOOR * mean))
    bad = written(bad.select("host", F.lit("block").alias("by_graph")), "blocked")
    return base.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))
