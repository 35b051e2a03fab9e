"""Selection of nodes and edges: alternatives within a kind of selector, all kinds together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.graph import ArgumentError, NoResults, SupplyGraph


def _label_in(labels: Column, keys: list[str]) -> Column:
    return F.coalesce(F.exists(labels, lambda x: x["key"].isin(keys)), F.lit(False))


def _label_is(labels: Column, pairs: list[tuple[str, str]]) -> Column:
    some = lambda x: reduce(Column.__or__, [(x["key"] == k) & (x["value"] == v) for k, v in pairs])
    return F.coalesce(F.exists(labels, lambda x: F.coalesce(some(x), F.lit(False))), F.lit(False))


@dataclass(frozen=True)
class Selectors:
    """Edge types restrict edges alone; identifiers, jurisdictions, names and node
    types restrict nodes alone; labels restrict either."""

    node_types: list[str] = field(default_factory=list)
    edge_types: list[str] = field(default_factory=list)
    label_keys: list[str] = field(default_factory=list)
    labels: list[tuple[str, str]] = field(default_factory=list)
    schemes: list[str] = field(default_factory=list)
    identifiers: list[tuple[str, str]] = field(default_factory=list)
    jurisdictions: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def for_nodes(self) -> bool:
        return any((self.node_types, self.label_keys, self.labels, self.schemes, self.identifiers, self.jurisdictions, self.names))

    def for_edges(self) -> bool:
        return any((self.edge_types, self.label_keys, self.labels))

    def is_empty(self) -> bool:
        return not (self.for_nodes() or self.for_edges())

    def nodes(self) -> Column:
        parts = []
        if self.node_types:
            parts.append(F.col("type").isin(self.node_types))
        if self.label_keys:
            parts.append(_label_in(F.col("labels"), self.label_keys))
        if self.labels:
            parts.append(_label_is(F.col("labels"), self.labels))
        if self.schemes:
            parts.append(F.coalesce(F.exists("identifiers", lambda x: x["scheme"].isin(self.schemes)), F.lit(False)))
        if self.identifiers:
            some = lambda x: reduce(Column.__or__, [(x["scheme"] == s) & (x["value"] == v) for s, v in self.identifiers])
            parts.append(F.coalesce(F.exists("identifiers", some), F.lit(False)))
        if self.jurisdictions:
            parts.append(F.coalesce(F.col("jurisdiction").isin(self.jurisdictions), F.lit(False)))
        if self.names:
            lower = F.lower("name")
            parts.append(F.coalesce(reduce(Column.__or__, [lower.contains(n.lower()) for n in self.names]), F.lit(False)))
        return reduce(Column.__and__, parts, F.lit(True))

    def edges(self) -> Column:
        parts, labels = [], F.col("properties.labels")
        if self.edge_types:
            parts.append(F.col("type").isin(self.edge_types))
        if self.label_keys:
            parts.append(_label_in(labels, self.label_keys))
        if self.labels:
            parts.append(_label_is(labels, self.labels))
        return reduce(Column.__and__, parts, F.lit(True))


def parse(node_type=(), edge_type=(), label=(), identifier=(), jurisdiction=(), name=()) -> Selectors:
    """From command-line words: key or key=value, scheme or scheme:value."""
    split = lambda words, mark: ([w for w in words if mark not in w], [tuple(w.split(mark, 1)) for w in words if mark in w])
    keys, pairs = split(label, "=")
    schemes, idents = split(identifier, ":")
    out = Selectors(list(node_type), list(edge_type), keys, pairs, schemes, idents, list(jurisdiction), list(name))
    if out.is_empty():
        raise ArgumentError("at least one selector is needed")
    return out


def match(graph: SupplyGraph, s: Selectors) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges that match; all of both for no selectors."""
    if s.is_empty():
        return graph.nodes, graph.edges
    none = F.lit(False)
    return graph.nodes.where(s.nodes() if s.for_nodes() else none), graph.edges.where(s.edges() if s.for_edges() else none)


def query(graph: SupplyGraph, s: Selectors, strict: bool = False) -> DataFrame:
    """(kind, id, type, detail): a node's name, an edge's ends. ``strict``: none is an error."""
    nodes, edges = match(graph, s)
    out = nodes.select(F.lit("node").alias("kind"), "id", "type", F.coalesce("name", F.lit("")).alias("detail")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "id", "type", F.concat_ws(" -> ", "source", "target").alias("detail"))
    )
    if strict and not out.limit(1).count():
        raise NoResults("no node or edge matches")
    return out


def counts(graph: SupplyGraph, s: Selectors) -> DataFrame:
    return query(graph, s).groupBy("kind").agg(F.count("*").alias("n"))
