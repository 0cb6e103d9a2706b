"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

Rules are compiled into one expression. Hosts that the rules mostly allow or mostly block are
seeds. Trust flows from the allowed ones along host edges (personalised PageRank), distrust from
the blocked ones against them, and a host with clearly more distrust is blocked. Both ranks are
sums over joins with one row per host; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut
from chronoloom.operators.lookup import lookup_join

DAMPING, STEPS = 0.85, 12
# A host is blocked when its distrust is above its trust and at least this part of what a blocked
# seed starts with; both in units of what a seed of their kind starts with.
LEAST_DISTRUST = 0.25
# Share of a host's pages that rules must decide alike to make it a seed.
SEED_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
_LINKS = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class UrlRule:
    """``where`` is a host and a path prefix, such as ``example.com/en/``."""

    where: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.where.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


RULES = (
    UrlRule("com/", True),
    UrlRule("example.com/en/", False),
    UrlRule("www.example.com/en/", True),
    UrlRule("net/es/", False),
    UrlRule("net/fr/", False),
)


def _parsed(pages: DataFrame, page_id: str, url: str, html: str, rules: Sequence[UrlRule]) -> DataFrame:
    address = F.coalesce(F.col(url), F.lit(""))
    split = pages.select(
        F.col(page_id).alias("page_id"),
        F.translate(F.regexp_extract(address, _PARTS, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(address, _PARTS, 2).alias("path"),
        F.col(html).alias("html"),
    )
    longest = sorted(rules, key=lambda r: (-len(r.where), r.where))
    fits = [F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.where)) for r in longest]
    return split.withColumn("rule", F.coalesce(F.lit(None).cast("string"), *fits))


def _allowed(rules: Sequence[UrlRule]) -> Column:
    """True or false by the row's rule, null without one."""
    said = F.lit(None).cast("boolean")
    for r in rules:
        said = F.when(F.col("rule") == r.where, F.lit(r.allow)).otherwise(said)
    return said


def host_edges(parsed: DataFrame) -> DataFrame:
    """(a, b, weight): links of pages to other hosts, weighted by their number."""
    linked = parsed.select(
        F.col("host").alias("a"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINKS), 1)).alias("b"),
    ).withColumn("b", F.translate("b", _UPPER, _LOWER))
    return linked.filter((F.col("a") != "") & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, rank) by personalised PageRank from ``seeds`` (host, seed), which sum to one.

    Mass of hosts without edges is let go; only the order and the ratio of ranks count.
    """
    total = edges.groupBy(F.col("a").alias("from")).agg(F.sum("weight").alias("total"))
    shares = cut(
        edges.join(total, F.col("a") == F.col("from")).select(
            "a", "b", (F.col("weight") / F.col("total")).alias("share")
        )
    )
    base = cut(seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank")))
    ranks = base
    for step in range(steps):
        moved = shares.join(ranks, F.col("a") == F.col("host")).select(
            F.col("b").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
        )
        ranks = base.union(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % 4 == 3:
            ranks = cut(ranks)
    return ranks


def _seeds(hosts: DataFrame, kind: str) -> tuple[DataFrame, int]:
    chosen = hosts.filter(F.col(kind) > SEED_SHARE * F.col("pages")).select("host")
    n = max(1, chosen.count())
    return chosen.withColumn("seed", F.lit(1.0 / n)), n


def host_verdicts(parsed: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """(host, trust, distrust, blocked) for every host of the pages."""
    said = _allowed(rules)
    hosts = cut(
        parsed.groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count(F.when(said, 1)).alias("allowed"),
            F.count(F.when(~said, 1)).alias("barred"),
        )
    )
    edges = cut(host_edges(parsed))
    trusted, n_trusted = _seeds(hosts, "allowed")
    blocked, n_blocked = _seeds(hosts, "barred")
    trust = spread(edges, trusted).select(
        F.col("host").alias("t_host"), F.col("rank").alias("trust")
    )
    against = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    distrust = spread(against, blocked).select(
        F.col("host").alias("d_host"), F.col("rank").alias("distrust")
    )
    both = (
        hosts.join(trust, F.col("host") == F.col("t_host"), "left")
        .join(distrust, F.col("host") == F.col("d_host"), "left")
        .select(
            "host",
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )
    # In units of one seed, so that no verdict depends on how many seeds the corpus has of a kind.
    t, d = (F.col(k) * n / (1 - DAMPING) for k, n in (("trust", n_trusted), ("distrust", n_blocked)))
    return both.withColumn("blocked", (d >= LEAST_DISTRUST) & (d > t))


def filtered(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules: Sequence[UrlRule] = RULES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    ``rule`` is the longest that fits, ``verdict`` its word, or that of the host's ranks where no
    rule fits; without any evidence a host is allowed. Defined cases: a null url or one without
    ``://`` has empty host and path and is allowed; a null html has no links; repeated rows and
    equal ids are judged one by one; other columns are ignored; an empty table gives an empty one.
    """
    parsed = _parsed(pages, page_id, url, html, rules)
    hosts = cut(host_verdicts(parsed, rules)).withColumnRenamed("host", "of_host")
    judged = lookup_join(parsed.drop("html"), hosts, {"host": "of_host"})
    allow = F.coalesce(_allowed(rules), ~F.col("blocked"), F.lit(True))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(allow, "allow").otherwise("block").alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
