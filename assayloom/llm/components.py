"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import cut, spread_join


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies")).select("u", F.least("u", "m").alias("m"), "copies")
    return spread_join(both.filter("v > u"), low, "u", total=2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies"))
    moved = spread_join(edges, low, "u", total=total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long); the component is its smallest node.

    Edges with a null end and loops say nothing and are left out; repeated edges count once; no edges give no rows. Each
    round is kept in the shared folder, so a lost executor repeats one round only; a node with a large share of the edges is met where they are. The rounds grow with the logarithm of the
    longest chain; should ``most_rounds`` not suffice, the call raises rather than return components that are too small.
    """
    e = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, before = cut(e), None
    for _ in range(most_rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())
        before = state
        e = cut(_small_star(cut(_large_star(e, state[0])), state[0]))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
