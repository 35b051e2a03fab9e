"""Connected components by alternating star contractions (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tiergraph.plans.shared import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction. Each row of ``edges`` is (u, v) with v < u.

    Large star: every node hands its larger neighbours to the least node it
    knows. Small star: every node hands its smaller neighbours, and itself, on.
    The minimum is a grouped aggregate that combines before the shuffle, and the
    join back is one that adaptive execution can split, so hubs do no harm.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the least
    node that can be reached.  Self links and repeated links do no harm, links
    with a null end are ignored, and no links give no rows."""
    edges = (
        links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = written(edges, "edges")
    before = None
    for _ in range(max_rounds):
        # Counted while it is written: each round is one job.
        seen = Observation()
        edges = written(_stars(_stars(edges, small=False), small=True).observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), "edges")
        now = (seen.get["n"], seen.get["x"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
