"""Counts over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.graph import SupplyGraph


def node_counts(g: SupplyGraph) -> DataFrame:
    return g.nodes.groupBy("type").agg(F.count("*").alias("n"))


def edge_counts(g: SupplyGraph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


def identifier_counts(g: SupplyGraph) -> DataFrame:
    """By scheme, of nodes and edges."""
    both = g.nodes.select(F.explode("identifiers").alias("i")).unionByName(g.edges.select(F.explode("identifiers").alias("i")))
    return both.groupBy(F.col("i.scheme").alias("scheme")).agg(F.count("*").alias("n"))


def totals(g: SupplyGraph) -> DataFrame:
    """One row: the header, and how many nodes and edges there are."""
    n, e = g.nodes.agg(F.count("*").alias("nodes")), g.edges.agg(F.count("*").alias("edges"))
    return g.header.crossJoin(n).crossJoin(e)  # one row each


def owned(g: SupplyGraph) -> DataFrame:
    """(target, total): the shares in each organization."""
    return g.edges_of_type("ownership").groupBy("target").agg(F.sum("properties.percentage").alias("total"))
