"""Breadth-first traversal as joins of a frontier with two narrow columns.

The driver holds the loop and counts; every level is a written table, so the
plan does not grow with the depth and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.graph import NoResults, SupplyGraph
from tiergraph.plans.shared import written

DIRECTIONS = {"outgoing": "forward", "incoming": "backward", "both": "both"}


def expand(adj: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of all that can be reached from the ids of ``start``, they too, at depth 0."""
    seen = frontier = written(start.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    adj = written(adj.distinct(), "adjacency")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(adj, frontier["id"] == adj["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = written(seen, "seen")
    return seen


def _ids(graph: SupplyGraph, *ids: str) -> DataFrame:
    spark = graph.nodes.sparkSession
    return spark.createDataFrame([(i,) for i in ids], "id string")


def reachable(graph: SupplyGraph, start: str, direction: str = "forward", edge_types: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of the nodes that can be reached; the start is not one of them,
    even if it lies on a cycle."""
    graph.require(start)
    out = expand(graph.adjacency(direction, edge_types), _ids(graph, start), max_depth)
    return out.where("depth > 0")


def shortest_path(graph: SupplyGraph, start: str, end: str, direction: str = "forward", edge_types: list[str] | None = None) -> list[str] | None:
    """The ids of a path of least length, of these the least in order; None if there is none."""
    graph.require(start, end)
    if start == end:
        return [start]
    adj = written(graph.adjacency(direction, edge_types).distinct(), "adjacency")
    frontier = _ids(graph, start).withColumn("path", F.array("id"))
    seen = frontier.select("id")
    while True:
        step = frontier.join(adj, frontier["id"] == adj["src"]).join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        frontier = written(step.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")), "level")
        found = frontier.where(F.col("id") == end).first()
        if found:
            return list(found.path)
        if not frontier.limit(1).count():
            return None
        seen = written(seen.unionByName(frontier.select("id")), "seen")


def all_paths(graph: SupplyGraph, start: str, end: str, max_depth: int = 20, direction: str = "forward", edge_types: list[str] | None = None) -> DataFrame:
    """(path) of all simple paths of up to ``max_depth`` edges; parallel edges give
    a path each; none goes on beyond the end."""
    graph.require(start, end)
    spark = graph.nodes.sparkSession
    if start == end:
        return spark.createDataFrame([([start],)], "path array<string>")
    adj = graph.adjacency(direction, edge_types)
    # Only nodes between both ends, within the depth, can be on such a path.
    before = expand(adj, _ids(graph, start), max_depth).select(F.col("id").alias("x"), F.col("depth").alias("from_start"))
    after = expand(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _ids(graph, end), max_depth).select(F.col("id").alias("x"), F.col("depth").alias("to_end"))
    between = written(before.join(after, "x").where(F.col("from_start") + F.col("to_end") <= max_depth), "between")
    adj = adj.join(between.select(F.col("x").alias("src")), "src", "left_semi").join(between.select(F.col("x").alias("dst"), "to_end"), "dst")
    adj = written(adj.select("src", "dst", "to_end"), "adjacency")
    frontier, done = _ids(graph, start).withColumn("path", F.array("id")), []
    for depth in range(1, max_depth + 1):
        step = frontier.join(adj, (frontier["id"] == adj["src"]) & (adj["to_end"] <= max_depth - depth))
        step = step.where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = written(step, "paths")
        done.append(step.where(F.col("id") == end).select("path"))
        frontier = step.where(F.col("id") != end)
        if not frontier.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def paths(graph: SupplyGraph, start: str, end: str, max_paths: int = 10, max_depth: int = 20, strict: bool = False) -> DataFrame:
    """The shortest ``max_paths`` simple paths over all edge types, equal lengths by id."""
    out = all_paths(graph, start, end, max_depth).orderBy(F.size("path"), "path").limit(max_paths)
    if strict and not out.limit(1).count():
        raise NoResults(f"no path from {start!r} to {end!r}")
    return out


def cyclic_core(graph: SupplyGraph, edge_types: list[str] | None = None) -> DataFrame:
    """(src, dst) that remain when nodes without incoming or without outgoing edges are peeled off."""
    adj = written(graph.adjacency("forward", edge_types).distinct(), "core")
    count = adj.count()
    while count:
        inner = adj.select(F.col("dst").alias("n")).intersect(adj.select(F.col("src").alias("n")))
        adj = written(adj.join(inner.withColumnRenamed("n", "src"), "src", "left_semi").join(inner.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"), "core")
        before, count = count, adj.count()
        if before == count:
            break
    return adj


def _spread_least(adj: DataFrame) -> DataFrame:
    """(id, color): the least id that reaches each node, or the node's own."""
    color = written(adj.select(F.col("src").alias("id")).union(adj.select("dst")).distinct().withColumn("color", F.col("id")), "color")
    while True:
        got = adj.join(color, adj["src"] == color["id"]).groupBy("dst").agg(F.min("color").alias("got"))
        new = color.join(got, color["id"] == got["dst"], "left").select("id", F.least("color", "got").alias("color"), (F.col("got") < F.col("color")).alias("moved"))
        new = written(new, "color")
        color = new.select("id", "color")
        if not new.where("moved").limit(1).count():
            return color


def cycle_components(graph: SupplyGraph, edge_types: list[str] | None = None) -> DataFrame:
    """(id, component) of the nodes that lie on a cycle; component is the least id of
    the strongly connected set. Colouring: each round settles the set of every root."""
    adj, out = cyclic_core(graph, edge_types), None
    while adj.limit(1).count():
        color = _spread_least(adj)
        own = adj.join(color.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd")
        own = written(own.select("src", "dst", F.col("cs").alias("color")), "own")
        # Backwards from each root inside its colour: what is met is its component.
        back = own.select(F.struct("color", F.col("dst").alias("n")).alias("src"), F.struct("color", F.col("src").alias("n")).alias("dst"))
        roots = own.select(F.struct("color", F.col("color").alias("n")).alias("id")).distinct()
        met = expand(back, roots).select(F.col("id.n").alias("id"), F.col("id.color").alias("component"))
        loops = own.where("src = dst").select(F.col("src").alias("id"))
        size = met.groupBy("component").count()
        found = met.join(size, "component").join(loops.distinct().withColumn("loop", F.lit(True)), "id", "left").where("count > 1 or loop")
        found = written(found.select("id", "component"), "cycles")
        out = found if out is None else out.unionByName(found)
        left = adj.join(met.select(F.col("id").alias("src")), "src", "left_anti").join(met.select(F.col("id").alias("dst")), "dst", "left_anti")
        adj = written(left.select("src", "dst"), "core")
    return out if out is not None else adj.select(F.col("src").alias("id"), F.col("dst").alias("component"))


def detect_cycles(graph: SupplyGraph, edge_types: list[str] | None = None) -> DataFrame:
    """(component, cycle): for each cyclic set one closed path of least length through
    its least node, first and last the same; a self loop is [a, a]."""
    part = written(cycle_components(graph, edge_types), "cycles")
    adj = graph.adjacency("forward", edge_types).distinct()
    adj = adj.join(part.select(F.col("id").alias("src"), "component"), "src").join(part.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    adj = written(adj.select("component", "src", "dst"), "adjacency")
    frontier = part.select("component", F.col("component").alias("id")).distinct().withColumn("path", F.array("id"))
    seen, out = frontier.select("component", "id").where("false"), None
    while True:
        step = frontier.withColumnRenamed("id", "src").join(adj, ["component", "src"]).select("component", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, ["component", "id"], "left_anti").groupBy("component", "id").agg(F.min("path").alias("path"))
        step = written(step, "level")
        closed = step.where("id = component").select("component", F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        frontier = step.join(closed.select("component"), "component", "left_anti")
        if not frontier.limit(1).count():
            return out
        seen = written(seen.unionByName(step.select("component", "id")), "seen")
