"""URL filter by link-graph propagation: trust and distrust over host edges, in DataFrame functions only.

Rules judge a url by its host and path; the longest fitting rule wins. Hosts that no rule judges are
judged by the link graph: personalised PageRank spreads trust from hosts with allowed pages along the
links, and distrust from hosts with blocked pages against the links (who links to a blocked host is
suspect). A host is blocked if its distrust is at least BLOCK_SHARE of both; a host that neither reaches
is allowed.

Links are reduced to weighted host edges before anything is joined, so a host with a third of all pages
is one row an edge. A round joins the ranks (one row a host) with the edges and sums by host, with
map-side sums; ranks are written to the checkpoint folder every round. Rounds end at ROUNDS or when no
more than TOLERANCE of the mass moved; a graph with no edges between hosts takes none.

The documents' own tables may have no links between hosts at all; then no round is taken and every host is
judged by its own pages.

Defined results: a url that is null or has no "://" has an empty host and path, fits no rule and is
judged as the host ""; null html has no links; repeated rows give repeated results; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, spread_join

DAMPING, ROUNDS, TOLERANCE, BLOCK_SHARE = 0.85, 20, 1e-4, 0.5
#: Absolute and protocol-relative links; a relative link stays on its host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The rules of the query.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The rule that fits best and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Columns source, target, weight: links between different hosts, counted (pages has a column host)."""
    links = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))).alias("target"))
    links = links.select("source", ascii_lower(F.col("target")).alias("target")).where("source <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: columns host and rank, of edges (source, target, weight) and seeds (host, mass; summing to 1).

    What flows out of hosts without links returns to the seeds.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = cut(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    seeds = cut(seeds.where("mass > 0"))
    ranks = seeds.select("host", F.col("mass").alias("rank"))
    for _ in range(rounds):
        given = shares.join(ranks, F.col("source") == F.col("host")).groupBy(F.col("target").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        given = cut(given)
        kept = 1.0 - (given.agg(F.sum("rank")).first()[0] or 0.0)
        moved = given.union(seeds.select("host", (F.col("mass") * kept).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        moved = cut(moved)
        change = moved.alias("n").join(ranks.alias("o"), "host", "full").agg(F.sum(F.abs(F.coalesce("n.rank", F.lit(0.0)) - F.coalesce("o.rank", F.lit(0.0))))).first()[0] or 0.0
        ranks = moved
        if change <= tolerance:
            break
    return ranks


def judge_hosts(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Columns host, trust, distrust, host_verdict of every host, from pages with columns host and verdict (of rules)."""
    edges = cut(host_edges(pages, html))
    hosts = pages.groupBy("host").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")
    )
    hosts = cut(hosts.union(edges.select(F.col("target").alias("host"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).distinct()).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    hosts = hosts.withColumns({k: F.coalesce(F.try_divide(F.col(n), F.col("allowed") + F.col("blocked")), F.lit(0.0)) for k, n in (("good", "allowed"), ("bad", "blocked"))})
    sums = hosts.agg(F.sum("good"), F.sum("bad")).first()
    ranks = []
    for column, total, way in (("good", sums[0], edges), ("bad", sums[1], edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))):
        seeds = hosts.select("host", (F.col(column) / F.lit(float(total or 1.0))).alias("mass"))
        ranks.append(propagate(way, seeds, rounds=0 if edges.isEmpty() else ROUNDS))
    trust, distrust = ranks
    judged = hosts.select("host").join(trust.select("host", F.col("rank").alias("trust")), "host", "left").join(distrust.select("host", F.col("rank").alias("distrust")), "host", "left")
    judged = judged.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCK_SHARE * (F.col("trust") + F.col("distrust")))
    return judged.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Of every page: `key`, host, path, rule, verdict, trust, distrust."""
    host, path = host_and_path(pages[url])
    rows = pages.select(pages[key].alias("key"), host.alias("host"), path.alias("path"), pages[html].alias("html"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    # The pages of a frequent host, however many, are dealt to several tasks.
    rows, hosts = rows.drop("html"), judge_hosts(rows)
    return spread_join(rows, hosts, "host").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", "host_verdict").alias("verdict"), "trust", "distrust"
    )
