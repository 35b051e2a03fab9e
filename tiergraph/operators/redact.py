"""Redaction of a snapshot for a target scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.functions import expr as X
from tiergraph.graph import ArgumentError, InvalidOutput, SupplyGraph
from tiergraph.plans.shared import written


def actions(g: SupplyGraph, scope: str, retain: DataFrame | None = None) -> DataFrame:
    """(id, action): omit persons in public, retain boundary references and the ids
    of ``retain``, replace the rest."""
    nodes = g.nodes.select("id", "type")
    if retain is None:
        nodes = nodes.withColumn("_kept", F.lit(None).cast("string"))
    else:
        nodes = nodes.join(retain.select(F.col("id").alias("_kept")).distinct(), F.col("id") == F.col("_kept"), "left")
    omit = F.lit(scope == "public") & (F.col("type") == "person")
    action = F.when(omit, "omit").when((F.col("type") == "boundary_ref") | F.col("_kept").isNotNull(), "retain").otherwise("replace")
    return nodes.select("id", action.alias("action"))


def public_canonicals(identifiers, node_type):
    """Canonical forms of the identifiers of a node that anyone may see."""
    seen = F.filter(F.coalesce(identifiers, F.array()), lambda x: X.sensitivity(x, node_type) == "public")
    return F.transform(seen, X.canonical)


def boundary_token(g: SupplyGraph, token=None):
    """The opaque value of a stub: a salted hash, or what ``token`` gives for a node without
    a public identifier, else 32 random bytes: those of three numbers from the secure
    generator of the runtime, hashed.  They are drawn anew whenever the plan runs."""
    known = public_canonicals(F.col("identifiers"), F.col("type"))
    drawn = F.concat(*[F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID")) for _ in range(3)])
    free = F.sha2(drawn, 256) if token is None else token
    return F.when(F.size(known) > 0, X.boundary_hash(known, F.col("_salt"))).otherwise(F.substring(free, 1, 64))


def redact_nodes(g: SupplyGraph, scope: str, retain: DataFrame | None = None, token=None) -> DataFrame:
    salt = g.header.agg(F.min_by("file_salt", "file_idx").alias("_salt"))  # one row
    kept = g.nodes.join(actions(g, scope, retain).distinct(), "id").where("action <> 'omit'").crossJoin(salt)
    stub = F.array(S.identifier("opaque", boundary_token(g, token)))
    shown = F.filter("identifiers", lambda x: X.allowed(X.sensitivity(x, F.col("type")), scope))
    shown = F.when(F.size(shown) > 0, shown)
    replaced = F.col("action") == "replace"
    columns = []
    for c, t in S.NODE.items():
        if c == "identifiers":
            columns.append(F.when(replaced, stub).otherwise(shown).alias(c))
        elif c == "type":
            columns.append(F.when(replaced, "boundary_ref").otherwise(F.col(c)).alias(c))
        elif c in ("file_idx", "ordinal", "id"):
            columns.append(F.col(c))
        else:
            columns.append(F.when(~replaced, F.col(c)).cast(t).alias(c))
    return kept.select(*columns)


def redact_edges(g: SupplyGraph, scope: str, retain: DataFrame | None = None) -> DataFrame:
    """Edges between two retained nodes, or one retained and one replaced; properties
    that the scope may not see are null."""
    act = actions(g, scope, retain).distinct()
    ends = [act.select(F.col("id").alias(end), F.col("action").alias("_" + end)) for end in ("source", "target")]
    edges = g.edges.join(ends[0], "source").join(ends[1], "target")
    keep = (F.col("_source") != "omit") & (F.col("_target") != "omit") & ~((F.col("_source") == "replace") & (F.col("_target") == "replace"))
    if scope == "public":
        keep &= F.col("type") != "beneficial_ownership"
    extra = F.col("properties.extra")
    fields = []
    for name, t in S.PROPERTY_FIELDS.items():
        value = F.col(f"properties.{name}")
        if name == "extra":
            if scope == "public":
                value = F.when(~F.coalesce(extra.contains("_property_sensitivity"), F.lit(False)), extra).otherwise(without_key(extra, "_property_sensitivity"))
        else:
            shown = "valid_to" if name == "valid_to_present" else name
            value = F.when(X.allowed(X.property_sensitivity(shown, F.col("type"), extra), scope), value)
        fields.append(value.cast(t).alias(name))
    return edges.where(keep).withColumn("properties", F.struct(*fields)).select(list(S.EDGE))


def without_key(json, key: str):
    """A JSON object without one of its keys; null if none is left."""
    left = F.map_filter(F.from_json(json, "map<string,variant>"), lambda k, v: k != key)
    return F.when(F.size(left) > 0, F.to_json(left))


def redact(g: SupplyGraph, scope: str, retain: DataFrame | None = None, token=None, check: bool = True) -> SupplyGraph:
    if scope not in S.SCOPES:
        raise ArgumentError(f"no scope: {scope!r}")
    header = g.header.withColumn("disclosure_scope", F.lit(scope))
    if scope == "internal":
        return SupplyGraph(header, g.nodes, g.edges)
    # Written once: random tokens must be the same for the check, the statistics and the output.
    nodes = written(redact_nodes(g, scope, retain, token), "redacted")
    out = SupplyGraph(header, nodes, redact_edges(g, scope, retain))
    if check:
        from tiergraph.operators.validate import is_valid

        if not is_valid(out):
            raise InvalidOutput("the redacted snapshot breaks a rule of level 1")
    return out


def narrower(now: str | None, scope: str) -> None:
    """A scope may be tightened and not widened."""
    if now is not None and S.SCOPES.index(scope) < S.SCOPES.index(now):
        raise ArgumentError(f"scope {now} can't become {scope}")


def statistics(g: SupplyGraph, out: SupplyGraph) -> DataFrame:
    """One row: nodes kept as they were, replaced and omitted, and edges kept and omitted."""
    one = out.nodes.agg(
        F.count_if(F.col("type") != "boundary_ref").alias("nodes_retained"), F.count_if(F.col("type") == "boundary_ref").alias("boundary_refs"), F.count("*").alias("_n")
    )
    both = one.crossJoin(g.nodes.agg(F.count("*").alias("_all"))).crossJoin(out.edges.agg(F.count("*").alias("edges_retained"))).crossJoin(g.edges.agg(F.count("*").alias("_edges")))
    return both.select("nodes_retained", "boundary_refs", (F.col("_all") - F.col("_n")).alias("nodes_omitted"), "edges_retained", (F.col("_edges") - F.col("edges_retained")).alias("edges_omitted"))
