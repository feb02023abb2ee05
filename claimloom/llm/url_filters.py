"""URL filters: host and path rules, and link-graph propagation for what no rule decides.

A rule fits its host and all subdomains where the path starts with the rule's; the longest
decides.  A host is a trusted seed by the share of its pages that rules allow, and a blocked
seed by the share that rules block (callers may name other seeds).  Over the edges between hosts, taken from the pages' links and added up by pair of hosts:

* trust is personalised PageRank from the trusted seeds along links;
* distrust is the same from the blocked seeds against the links: who links to a blocked host
  is distrusted.

A host is blocked if its distrust is more than its trust and at least ``least_distrust`` of
what a host with only blocked pages starts with.

Edges are counts per pair of hosts, so a host with a third of all pages is one node.  Each
round is one join and one aggregation over edges, written down.  What a round moves is at most
``damping`` times what the round before moved, so rounds go on until that is at most
``tolerance`` of the seeds' mass.

Without links between hosts (the given pages have only relative ones) nothing is passed on, and a
host's undecided pages go by the shares of its own pages that rules allow and block.

Defined results: a null url, or one without ``://``, has an empty host and path and no edges;
null html has no links; links of a host to itself do not count; repeated rows are judged each;
an empty table gives an empty result.  Only the id, url and html columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    tolerance: float = 1e-6
    least_distrust: float = 0.1


def lower_host(host: Column) -> Column:
    return F.translate(host, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lower_host(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], part: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, the first of equals; else null."""
    found = F.lit(None).cast("string")
    # What is set last counts: the longest, and of equally long ones the first.
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, part))).otherwise(found)
    return found


def edges(pages: DataFrame) -> DataFrame:
    """``(source, target, links)`` between different hosts, from ``(host, html)``."""
    targets = F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1))
    links = pages.where("host != ''").select(F.col("host").alias("source"), targets.alias("target"))
    links = links.select("source", lower_host(F.col("target")).alias("target")).where("source != target and target != ''")
    return links.groupBy("source", "target").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, how: Propagation) -> DataFrame:
    """``(host, score)``: personalised PageRank from ``seeds (host, mass)`` along ``(source, target, links)``.

    A seed starts with mass * (1 - damping); seeds without the column have mass 1.
    """
    out = edges.groupBy("source").agg(F.sum("links").alias("out"))
    steps = durable(edges.join(out, "source").select("source", "target", (F.col("links") / F.col("out")).alias("share")))
    mass = F.col("mass") if "mass" in seeds.columns else F.lit(1.0)
    start = durable(seeds.groupBy("host").agg(F.max(mass * (1 - how.damping)).alias("score")))
    now = start
    mass_moved = (start.agg(F.sum("score")).first()[0] or 0.0) / (1 - how.damping)
    while True:
        moved = now.join(steps, now["host"] == steps["source"]).select(F.col("target").alias("host"), (F.col("score") * F.col("share") * how.damping).alias("score"))
        after = durable(moved.union(start).groupBy("host").agg(F.sum("score").alias("score")))
        before = now.select("host", F.col("score").alias("was"))
        change = after.join(before, "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        now = after
        if (change or 0.0) <= how.tolerance * mass_moved:
            return now


def host_scores(pages: DataFrame, trusted: DataFrame, blocked: DataFrame, how: Propagation) -> DataFrame:
    """``(host, trust, distrust)`` of every host that a seed reaches."""
    links = durable(edges(pages))
    trust = propagated(links, trusted, how).withColumnRenamed("score", "trust")
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "links")
    distrust = propagated(back, blocked, how).withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host", "full")
    return both.select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])


def judged(
    pages: DataFrame,
    rules: tuple[Rule, ...],
    how: Propagation = Propagation(),
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    trusted: DataFrame | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    rows = pages.select(pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), pages[html].alias("html"))
    rule = lambda part: rule_of(F.col("host"), F.col("path"), rules, part)
    ruled = durable(rows.select("page_id", "host", "path", rule("name").alias("rule"), rule("verdict").alias("by_rule")))
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1).otherwise(0))
    hosts = durable(ruled.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    trusted = hosts.where("allowed > 0").select("host", F.col("allowed").alias("mass")) if trusted is None else trusted
    blocked = hosts.where("blocked > 0").select("host", F.col("blocked").alias("mass")) if blocked is None else blocked
    scores = host_scores(rows, trusted, blocked, how)
    met = ruled.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= how.least_distrust * (1 - how.damping))
    verdict = F.coalesce("by_rule", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
