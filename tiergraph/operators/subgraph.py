"""Parts of a graph: induced by nodes, around a node, or around a selection."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.graph import ArgumentError, NodeNotFound, NoResults, SupplyGraph
from tiergraph.operators.select import Selectors, match
from tiergraph.operators.traverse import _ids, expand


def induced(graph: SupplyGraph, ids: DataFrame, check: bool = True) -> SupplyGraph:
    """The nodes with the ids, the edges with both ends among them, the header; a
    reporting entity that is not among them is dropped."""
    ids = ids.select("id").distinct()
    if check:
        lost = ids.join(graph.nodes.select("id"), "id", "left_anti").limit(1).collect()
        if lost:
            raise NodeNotFound(f"there is no node {lost[0].id!r}")
    nodes = graph.nodes.join(ids, "id", "left_semi").select(graph.nodes.columns)
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    kept = graph.header.join(ids.withColumnRenamed("id", "_kept"), F.col("reporting_entity") == F.col("_kept"), "left")
    header = kept.withColumn("reporting_entity", F.col("_kept")).select(graph.header.columns)
    return SupplyGraph(header, nodes, edges.select(graph.edges.columns))


def ego(graph: SupplyGraph, center: str, radius: int, direction: str = "both") -> SupplyGraph:
    graph.require(center)
    return induced(graph, expand(graph.adjacency(direction), _ids(graph, center), radius), check=False)


def seeds(graph: SupplyGraph, s: Selectors) -> DataFrame:
    nodes, edges = match(graph, s)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.select("id").unionByName(ends).distinct()


def selected(graph: SupplyGraph, s: Selectors, hops: int = 0, strict: bool = True) -> SupplyGraph:
    """What matches, the ends of edges that match, and what is within ``hops`` of them."""
    if s.is_empty():
        return graph
    start = seeds(graph, s)
    if strict and not start.limit(1).count():
        raise NoResults("no node or edge matches")
    return induced(graph, expand(graph.adjacency("both"), start, hops), check=False)


def subgraph(graph: SupplyGraph, ids: list[str] = (), selectors: Selectors | None = None, hops: int = 0, today: str | None = None) -> SupplyGraph:
    """Around ids and selections together; the snapshot gets a new date."""
    if not ids and (selectors is None or selectors.is_empty()):
        raise ArgumentError("ids or selectors are needed")
    start = None
    if ids:
        graph.require(*ids)
        start = _ids(graph, *ids)
    if selectors is not None and not selectors.is_empty():
        found = seeds(graph, selectors)
        start = found if start is None else start.unionByName(found)
    if not start.limit(1).count():
        raise NoResults("no node or edge matches")
    out = induced(graph, expand(graph.adjacency("both"), start, hops), check=False)
    date = today or datetime.date.today().isoformat()
    return SupplyGraph(out.header.withColumn("snapshot_date", F.lit(date)), out.nodes, out.edges)
