"""URL rules, and trust propagated over host links, with DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import cut, spread_join

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Mass of one seed page. Masses are whole numbers, so sums do not depend on their order; they stay under 10**34 for 10**10 pages.
UNIT = 10**24
MASS = "decimal(38,0)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
MOST_RULES = 256
#: Percent of a host's mass that its links carry on, and the share of all mass that may still move when the walk ends.
DAMPING, TOLERANCE = 85, 1e-3


def rounds_for(damping: int = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Steps after which masses are within ``tolerance`` of the fixed point: what is unsettled shrinks by the damping each step."""
    return math.ceil(math.log(tolerance) / math.log(damping / 100))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(verdict: str, *texts: str) -> list[Rule]:
    return [Rule(verdict, *(t[: t.index("/")], t[t.index("/") :])) for t in texts]


RULES = rules("block", "com/en/", "example.net/de/8", "org/es/") + rules("allow", "example.com/en/7", "net/de/")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where there is no ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(part(1), UPPER, LOW), part(2)


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def _first(host: Column, path: Column, ordered: list[Rule], what) -> Column:
    return F.coalesce(*(F.when(_fits(host, path, r), F.lit(what(r))) for r in ordered), F.lit(None).cast("string"))


def _share(mass: Column, times: Column, parts: Column) -> Column:
    """floor(mass * times / parts), one at least, for times <= parts; products stay within 38 digits."""
    whole = lambda a: ((a - a % parts) / parts).cast(MASS)  # noqa: E731  (div would give a long)
    return F.greatest((whole(mass) * times).cast(MASS) + whole(((mass % parts) * times).cast(MASS)), F.lit(1)).cast(MASS)


def _walk(seeds: DataFrame, edges: DataFrame, rounds: int, damping: int) -> DataFrame:
    """(side, host, mass) after ``rounds`` steps of personalised PageRank, from ``seeds`` (side, host, pages) over ``edges`` (side, src, dst, w).

    A step gives each seed its part of what does not walk on: 100 - ``damping`` percent of all mass, and the rest of what hosts
    without links held. A host's mass and the sum of its links' weights meet its links where they are if it has many of them.
    """
    out = cut(edges.groupBy("side", F.col("src").alias("host")).agg(F.sum("w").alias("all"), F.count("*").alias("copies")))
    n_edges = out.agg(F.sum("copies")).first()[0] or 0
    start = seeds.select("side", "host", (F.col("pages") * F.lit(Decimal(UNIT))).cast(MASS).alias("mass"))
    if not n_edges:
        return start
    pages = dict(seeds.groupBy("side").agg(F.sum("pages")).collect())  # two sides at most
    fixed = start.withColumn("mass", _share(F.col("mass"), F.lit(100 - damping).cast(MASS), F.lit(100).cast(MASS)))
    step = _share(F.col("mass"), F.col("w").cast("decimal(20,0)") * damping, F.col("all").cast("decimal(20,0)") * 100)
    held = cut(start.join(out, ["side", "host"], "left"))
    for _ in range(rounds):
        stuck = held.filter("copies is null").groupBy("side").agg(F.sum("mass").cast(MASS)).collect()
        sent = spread_join(edges, held.filter("copies is not null").withColumnRenamed("host", "src"), ["side", "src"], total=n_edges)
        parts = [fixed, sent.select("side", F.col("dst").alias("host"), step.alias("mass"))]
        for side, mass in stuck:
            back = _share(F.lit(mass).cast(MASS), F.col("pages").cast("decimal(20,0)") * damping, F.lit(pages[side]).cast("decimal(20,0)") * 100)
            parts.append(seeds.filter(F.col("side") == side).select("side", "host", back.alias("mass")))
        held = reduce(DataFrame.unionByName, parts).groupBy("side", "host").agg(F.sum("mass").cast(MASS).alias("mass"))
        held = cut(held.join(out, ["side", "host"], "left"))
    return held.select("side", "host", "mass")


def judge(pages: DataFrame, rule_list: list[Rule] = RULES, rounds: int | None = None, damping: int = DAMPING, least: float = -0.5) -> DataFrame:
    """(page_id long, host string, path string, rule string, verdict string, trust decimal(38,0), distrust decimal(38,0)), one row per row of ``pages``.

    A rule fits its host and that host's subdomains where the path starts with the rule's; the longest wins (a block, between
    equals). Pages that no rule fits take their host's verdict: each page a rule allows (blocks) gives its host one unit of
    trust (distrust); trust walks along the links between hosts and distrust against them, as personalised PageRank with
    ``damping`` percent, where mass at a host without such links goes back to the seeds. It takes ``rounds`` steps, as many as
    bring it within TOLERANCE of its fixed point where none are given. A host is blocked where
    (trust - distrust) / (trust + distrust) is under ``least``; one that neither reaches is allowed. A share of less than 1 / UNIT
    of a page counts as that much, so whatever is reached stays reached. Links within a host say nothing. Null urls and ones without
    ``://`` have an empty host, which has no links; null html has none; rows that repeat count each; an empty table gives no rows. At most MOST_RULES rules; more raise.
    """
    if len(rule_list) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rule_list, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    ruled = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = ruled.withColumns({"rule": _first(F.col("host"), F.col("path"), ordered, lambda r: r.text), "ruled": _first(F.col("host"), F.col("path"), ordered, lambda r: r.verdict)})

    seeds = cut(ruled.filter("ruled is not null and host <> ''").groupBy(F.col("ruled").alias("side"), "host").agg(F.count("*").alias("pages")))
    linked = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOW)))).alias("dst"))
    edges = cut(linked.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("w")))
    edges = edges.select(F.lit("allow").alias("side"), "src", "dst", "w").unionAll(edges.select(F.lit("block"), F.col("dst"), F.col("src"), F.col("w")))
    held = _walk(seeds, edges, rounds_for(damping) if rounds is None else rounds, damping)
    scores = held.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("side") == side, F.col("mass"))), F.lit(0)).cast(MASS).alias(name) for side, name in (("allow", "trust"), ("block", "distrust"))))
    bad = (F.col("trust") + F.col("distrust") > 0) & (F.col("trust") - F.col("distrust") < F.lit(Decimal(str(least))) * (F.col("trust") + F.col("distrust")))
    # All hosts with their number of pages, so that those with many are known and are not dealt out by name.
    hosts = cut(ruled.groupBy("host").agg(F.count("*").alias("copies")).join(scores, "host", "left"))
    return spread_join(ruled, hosts, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), *(F.coalesce(c, F.lit(0).cast(MASS)).alias(c) for c in ("trust", "distrust")))
