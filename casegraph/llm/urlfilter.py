"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

A page whose url fits a rule has that rule's verdict. All other pages have their host's: personalised PageRank spreads
from trusted seeds (hosts, by their pages that rules allow) along links, and from blocked seeds (hosts, by their pages
that rules block) against links, as who links to a blocked host is suspect. A host is blocked if its distrust is more than
`ratio` times its trust, both in units of seed pages.

With x = seeds + damping * (what the hosts that point here pass on), x is PageRank up to a factor in which mass of hosts
without links returns to the seeds, so no global sum is needed in a round. Rounds run on DataFrames keyed by host; every
few rounds the state goes to the shared checkpoint folder and the largest change to the driver.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule, is no part of the graph, and
is allowed; null html has no links; links within a host and links of other schemes than http(s) don't count; repeated rows
count as further pages; null ids are allowed; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING, RATIO, TOLERANCE, ROUNDS, EVERY = 0.85, 1.0, 1e-6, 150, 5

#: (verdict, host and path)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, of a short list."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from host to other host."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("dst"))
    dst = F.translate("dst", UPPER, LOWER)
    return found.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, seed) over edges (kind, src, dst, share); scores sum to the kind's seeds."""
    rank = seeds.select("kind", "host", F.col("seed").alias("x"))
    if not edges.isEmpty():
        rank = checkpointed(rank)
        last = rank
        # A hub's edges stay where they are; its score comes to them.
        fan = checkpointed(edges.groupBy("kind", "src").agg(F.count("*").alias("fan")))
        total = edges.count()
        for k in range(1, rounds + 1):
            scored = fan.join(rank.withColumnRenamed("host", "src"), ["kind", "src"])
            passed = join_hot(edges, scored, ["kind", "src"], "fan", total).select("kind", F.col("dst").alias("host"), (F.col("x") * F.col("share") * damping).alias("x"))
            rank = seeds.select("kind", "host", F.col("seed").alias("x")).union(passed).groupBy("kind", "host").agg(F.sum("x").alias("x"))
            if k % EVERY == 0:
                rank = checkpointed(rank)
                both = rank.join(last.withColumnRenamed("x", "before"), ["kind", "host"], "left")
                change = both.agg(F.sum(F.abs(F.col("x") - F.coalesce("before", F.lit(0.0)))), F.sum("x")).first()
                last = rank
                if (change[0] or 0.0) <= tolerance * (change[1] or 1.0):
                    break
        else:
            raise RuntimeError(f"the propagation did not settle in {rounds} rounds")
    totals = rank.groupBy("kind").agg(F.sum("x").alias("all")).join(seeds.groupBy("kind").agg(F.sum("seed").alias("of")), "kind")
    return rank.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("x") / F.col("all") * F.col("of")).alias("score"))  # one row per kind


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, trust and distrust of its host."""
    verdicts = {rule: verdict for verdict, rule in rules}
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    parts = parts.withColumn("by_rule", by_rule)

    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = checkpointed(parts.where("by_rule is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("seed")))
    out = checkpointed(links(pages, url_col, html_col))
    both = out.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(out.select(F.lit("distrust"), "dst", "src", "n"))
    degree = both.groupBy("kind", "src").agg(F.sum("n").alias("degree"))
    edges = checkpointed(both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("degree")).alias("share")))

    score = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    hosts = spread(seeds, edges).groupBy("host").agg(score("trust"), score("distrust"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # The margin keeps sums that are equal but for their order of addition on the side of allow.
    by_host = F.when(distrust > trust * ratio * (1 + 1e-6) + 1e-9, "block").otherwise("allow")
    # Pages of a hot host stay where they are, too.
    counted = checkpointed(parts.groupBy("host").agg(F.count("*").alias("n")).join(hosts, "host", "left"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return join_hot(parts, counted, ["host"], "n", total).select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
