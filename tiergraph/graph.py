"""The container of snapshots and its lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.functions.expr import canonical


class GraphError(Exception):
    """exit_code: 2 for input that can't be read or used, 1 for a logical outcome."""

    exit_code = 1


class NodeNotFound(GraphError):
    pass


class NoResults(GraphError):
    pass


class BuildError(GraphError):
    pass


class InvalidOutput(GraphError):
    pass


class ArgumentError(GraphError):
    exit_code = 2


@dataclass(frozen=True)
class SupplyGraph:
    """header has a row for each file; nodes and edges carry file_idx and ordinal,
    the place over all files."""

    header: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def identifiers(self) -> DataFrame:
        """(id, type, ordinal, pos, ident, canonical), a row for each identifier of a node."""
        rows = self.nodes.select("id", "type", "ordinal", F.posexplode("identifiers").alias("pos", "ident"))
        return rows.withColumn("canonical", canonical(F.col("ident")))

    def node_labels(self) -> DataFrame:
        return self.nodes.select("id", F.explode("labels").alias("label")).select("id", "label.*")

    def edge_labels(self) -> DataFrame:
        return self.edges.select("id", F.explode("properties.labels").alias("label")).select("id", "label.*")

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def nodes_of_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("type") == node_type)

    def edges_of_type(self, edge_type: str) -> DataFrame:
        return self.edges.where(F.col("type") == edge_type)

    def adjacency(self, direction: str = "forward", edge_types: list[str] | None = None) -> DataFrame:
        """(src, dst), a row for each edge and direction; parallel edges stay.

        Traversals carry these two columns alone and join attributes at the end."""
        edges = self.edges if edge_types is None else self.edges.where(F.col("type").isin(edge_types))
        out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
        back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
        return {"forward": out, "backward": back, "both": out.unionByName(back)}[direction]

    def neighbours(self, node_id: str, direction: str = "forward", edge_types: list[str] | None = None) -> DataFrame:
        return self.adjacency(direction, edge_types).where(F.col("src") == node_id).select(F.col("dst").alias("id"))

    def require(self, *ids: str) -> None:
        found = {r.id for r in self.nodes.where(F.col("id").isin(list(ids))).select("id").distinct().collect()}
        for i in ids:
            if i not in found:
                raise NodeNotFound(f"there is no node {i!r}")


def build(graph: SupplyGraph) -> SupplyGraph:
    """The graph itself if node ids are unique and edges end at nodes; else an
    error names the first fault: the id that is repeated first, or a missing source or target."""
    again = graph.nodes.select("id", "ordinal", F.row_number().over(Window.partitionBy("id").orderBy("ordinal")).alias("n")).where("n = 2").orderBy("ordinal").first()
    if again:
        raise BuildError(f"node id {again.id!r} is used more than once")
    known = graph.nodes.select("id")
    ends = graph.edges.select("ordinal", F.col("id").alias("edge"), F.posexplode(F.array("source", "target")).alias("end", "node"))
    lost = ends.join(known, ends["node"] == known["id"], "left_anti").orderBy("ordinal", "end").first()
    if lost:
        raise BuildError(f"edge {lost.edge!r}: its {('source', 'target')[lost.end]} {lost.node!r} is no node")
    return graph


