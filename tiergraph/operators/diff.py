"""What changed between two snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.components import components
from tiergraph.functions import expr as X
from tiergraph.graph import SupplyGraph
from tiergraph.operators.merge import edge_identity, externals
from tiergraph.plans.shared import written

EPSILON = 1e-9


@dataclass(frozen=True)
class Filter:
    node_types: list[str] | None = None
    edge_types: list[str] | None = None
    ignore: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Diff:
    nodes_added: DataFrame  # (id, type)
    nodes_removed: DataFrame
    node_changes: DataFrame  # (a_id, b_id, field, old_value, new_value)
    identifiers: DataFrame  # (a_id, b_id, canonical, change)
    labels: DataFrame  # (a_id, b_id, key, value, change)
    edges_added: DataFrame
    edges_removed: DataFrame
    edge_changes: DataFrame
    matched: DataFrame  # (a, b, matched_by)
    edges_matched: DataFrame  # (a, b)
    warnings: DataFrame  # (message)

    def summary(self) -> DataFrame:
        """One row of counts: added, removed, modified and unchanged nodes and edges."""
        changed = self.node_changes.select("a_id", "b_id").union(self.identifiers.select("a_id", "b_id")).union(self.labels.select("a_id", "b_id")).distinct()
        modified = self.edge_changes.select("a_id", "b_id").distinct()
        count = lambda df, name: df.agg(F.count("*").alias(name))
        out = count(self.nodes_added, "nodes_added")
        for df, name in ((self.nodes_removed, "nodes_removed"), (changed, "nodes_modified"), (self.matched, "_n"), (self.edges_added, "edges_added"), (self.edges_removed, "edges_removed"), (modified, "edges_modified"), (self.edges_matched, "_e")):
            out = out.crossJoin(count(df, name))  # one row each
        out = out.withColumn("nodes_unchanged", F.col("_n") - F.col("nodes_modified")).withColumn("edges_unchanged", F.col("_e") - F.col("edges_modified"))
        return out.drop("_n", "_e")

    def is_empty(self) -> bool:
        row = self.summary().first().asDict()
        return not any(v for k, v in row.items() if not k.endswith("unchanged"))


def match_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, matched_by) of ordinals; b's have been moved past a's. By shared
    identifiers that match, then by equal ids among the rest."""
    left, right = (identity_rows_all(x) for x in (a, b))
    ids = b.select(F.col("ordinal").alias("b"), F.col("identifiers").alias("_ib"))
    shared = left.select("canonical", F.col("ordinal").alias("a"), "ident").join(right.select("canonical", F.col("ordinal").alias("b")).distinct(), "canonical").join(ids, "b")
    hit = F.exists("_ib", lambda y: X.identifiers_match(F.col("ident"), y))
    by_id = shared.where(hit).groupBy("a", "b").agg(F.array_sort(F.collect_set("canonical")).alias("matched_by"))
    by_id = written(by_id, "matched")
    rest_a = a.select(F.col("ordinal").alias("a"), "id").join(by_id, "a", "left_anti")
    rest_b = b.join(by_id.select(F.col("b").alias("ordinal")), "ordinal", "left_anti").groupBy("id").agg(F.max("ordinal").alias("b"))
    by_name = rest_a.join(rest_b, "id").select("a", "b", F.array(F.concat(F.lit("node-id:"), F.col("id"))).alias("matched_by"))
    return by_id.unionByName(by_name)


def identity_rows_all(nodes: DataFrame) -> DataFrame:
    """As for merging, but annulled identifiers count."""
    rows = nodes.select("ordinal", F.explode("identifiers").alias("ident")).where(F.col("ident.scheme") != "internal")
    return rows.withColumn("canonical", X.canonical(F.col("ident")))


def _groups(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Within each group of matches all pairs count, and more than one on a side is worth a warning."""
    part = components(pairs.select("a", "b"))
    side_a = pairs.select("a").distinct().join(part.select(F.col("node").alias("a"), "component"), "a")
    side_b = pairs.select("b").distinct().join(part.select(F.col("node").alias("b"), "component"), "b")
    size = side_a.groupBy("component").agg(F.count("*").alias("na")).join(side_b.groupBy("component").agg(F.count("*").alias("nb")), "component")
    warnings = size.where("na > 1 or nb > 1").select(F.concat(F.lit("ambiguous match of "), F.col("na"), F.lit(" and "), F.col("nb"), F.lit(" nodes")).alias("message"))
    full = side_a.join(side_b, "component").join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("matched_by", F.array().cast("array<string>")).alias("matched_by"))
    return written(full, "pairs"), warnings


def unequal(x: Column, y: Column, kind: str) -> Column:
    """Present on one side alone, or different: numbers by more than 1e-9, texts with a
    dash on both sides as dates."""
    if kind == "double":
        differ = F.abs(x - y) >= EPSILON
    elif kind == "string":
        differ = F.when(x.contains("-") & y.contains("-"), X.normalised_date(x) != X.normalised_date(y)).otherwise(x != y)
    else:
        differ = x != y
    return (x.isNull() != y.isNull()) | F.coalesce(differ, F.lit(False))


def changes(pairs: DataFrame, fields: dict[str, str], x: str, y: str, ignore: list[str]) -> DataFrame:
    """(a_id, b_id, field, old_value, new_value) from rows with structs ``x`` and ``y``.

    Equal structs go first; of the others each field is a row, so that one small
    expression compares them all."""
    quality = {f"data_quality.{f}": "string" for f in ("confidence", "source", "last_verified")}
    out = []
    for name, kind in {**fields, **quality}.items():
        if name.split(".")[0] in ignore or name in ignore or name in ("identifiers", "labels", "valid_to_present"):
            continue
        one, two, forced = F.col(f"{x}.{name}"), F.col(f"{y}.{name}"), F.lit(False)
        if name == "data_quality":  # a missing side is a change of the whole, else each field counts
            forced = one.isNull() != two.isNull()
            one, two = F.when(forced, F.to_json(one)), F.when(forced, F.to_json(two))
        elif name in quality:
            both = F.col(f"{x}.data_quality").isNotNull() & F.col(f"{y}.data_quality").isNotNull()
            one, two = F.when(both, one), F.when(both, two)
        elif name == "valid_to":
            there = [F.coalesce(F.col(f"{s}.valid_to_present"), F.lit(False)) for s in (x, y)]
            forced = one.isNull() & two.isNull() & (there[0] != there[1])
        number = [c.cast("double") if kind == "double" else F.lit(None).cast("double") for c in (one, two)]
        out.append(F.struct(F.lit(name).alias("field"), one.cast("string").alias("old_value"), two.cast("string").alias("new_value"), number[0].alias("p"), number[1].alias("q"), forced.alias("forced")))
    rows = pairs.where(~F.col(x).eqNullSafe(F.col(y))).select("a_id", "b_id", F.explode(F.array(*out)).alias("c")).select("a_id", "b_id", "c.*")
    differ = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.abs(F.col("p") - F.col("q")) >= EPSILON).otherwise(unequal(F.col("old_value"), F.col("new_value"), "string"))
    return rows.where(F.col("forced") | differ).select("a_id", "b_id", "field", "old_value", "new_value")


def identifier_changes(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, canonical, change): added, removed, or modified in a field but scheme and value."""
    side = lambda s: pairs.select("a", "b", "a_id", "b_id", F.explode(F.coalesce(f"{s}.identifiers", F.array())).alias(s + "i")).where(F.col(s + "i.scheme") != "internal").withColumn("canonical", X.canonical(F.col(s + "i")))
    keys = ["a", "b", "a_id", "b_id", "canonical"]
    one, two = (side(s).groupBy(*keys).agg(F.last(s + "i").alias(s + "i")) for s in ("x", "y"))
    both = one.join(two, keys, "full_outer")
    fields = ("valid_from", "valid_to", "sensitivity", "verification_status", "verification_date", "authority", "extra")
    differ = F.lit(False)
    for f in fields:
        differ = differ | unequal(F.col(f"xi.{f}"), F.col(f"yi.{f}"), "string")
    differ = differ | (F.coalesce("xi.valid_to_present", F.lit(False)) != F.coalesce("yi.valid_to_present", F.lit(False)))
    change = F.when(F.col("xi").isNull(), "added").when(F.col("yi").isNull(), "removed").when(differ, "modified")
    return both.select("a_id", "b_id", "canonical", change.alias("change")).where("change is not null")


def label_changes(pairs: DataFrame, x: str = "x.labels", y: str = "y.labels") -> DataFrame:
    none = F.array().cast(f"array<{S.LABEL}>")
    one, two = F.coalesce(x, none), F.coalesce(y, none)
    mark = lambda arr, what: F.transform(arr, lambda v: F.struct(v["key"].alias("key"), v["value"].alias("value"), F.lit(what).alias("change")))
    rows = pairs.select("a_id", "b_id", F.explode(F.concat(mark(F.array_except(two, one), "added"), mark(F.array_except(one, two), "removed"))).alias("l"))
    return rows.select("a_id", "b_id", "l.*")


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Each of b, in order, takes the first of a that matches and has not been taken."""
    taken, out = set(), []
    for b, rows in pairs.sort_values(["b", "a"]).groupby("b"):
        first = next((a for a in rows.a if a not in taken), None)
        if first is not None:
            taken.add(first)
            out.append((first, b))
    return pd.DataFrame(out, columns=["a", "b"])


def match_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of edges with the same ends and type: rows (ordinal, src, dst, type,
    identifiers, properties), ends as group numbers.

    Edges without external identifiers pair off by rank within what identifies them.
    Others need a pair of identifiers that match; where an edge has several such partners,
    those of its ends and type are paired greedily."""
    key = ["src", "dst", "type"]
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).where("type <> 'same_as'")
    both = both.withColumn("_ext", externals(F.col("identifiers")))
    plain = both.where(F.size("_ext") == 0).select(*key, "side", "ordinal", edge_identity(F.col("type"), F.col("properties")).alias("key"))
    ranked = plain.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "key", "side").orderBy("ordinal")))
    keys = [*key, "key", "_nth"]
    pairs = ranked.where("side = 0").select(*keys, F.col("ordinal").alias("a")).join(ranked.where("side = 1").select(*keys, F.col("ordinal").alias("b")), keys).select("a", "b")

    each = both.select(*key, "side", "ordinal", F.explode("_ext").alias("i")).withColumn("_scheme", F.col("i.scheme")).withColumn("_value", X.trimmed(F.col("i.value")))
    on = [*key, "_scheme", "_value"]
    side = lambda n, name, ident: each.where(F.col("side") == n).select(*on, F.col("ordinal").alias(name), F.col("i").alias(ident))
    met = side(0, "a", "i").join(side(1, "b", "j"), on).where(X.identifiers_match(F.col("i"), F.col("j"))).select(*key, "a", "b").distinct()
    times = lambda c: F.count("*").over(Window.partitionBy(c))
    met = written(met.select("*", times("a").alias("_na"), times("b").alias("_nb")), "edges")
    rest = met.where("_na > 1 or _nb > 1").select(*key, "a", "b").groupBy(*key).applyInPandas(_greedy, "a long, b long")
    return pairs.unionByName(met.where("_na = 1 and _nb = 1").select("a", "b")).unionByName(rest)


def diff(a: SupplyGraph, b: SupplyGraph, only: Filter = Filter()) -> Diff:
    move = 1 << 52
    side = lambda g: g.nodes if only.node_types is None else g.nodes.where(F.col("type").isin(only.node_types))
    na, nb = side(a), side(b).withColumn("ordinal", F.col("ordinal") + move)
    matched, warnings = _groups(match_nodes(na, nb))
    version = a.header.limit(1).select(F.col("version").alias("va")).crossJoin(b.header.limit(1).select(F.col("version").alias("vb"))).where("va <> vb")
    warnings = version.select(F.concat(F.lit("versions differ: "), "va", F.lit(" and "), "vb").alias("message")).unionByName(warnings)
    x = na.select(F.col("ordinal").alias("a"), F.col("id").alias("a_id"), F.struct(*S.NODE_FIELDS).alias("x"))
    y = nb.select(F.col("ordinal").alias("b"), F.col("id").alias("b_id"), F.struct(*S.NODE_FIELDS).alias("y"))
    pairs = matched.join(x, "a").join(y, "b")
    added = nb.join(matched.select(F.col("b").alias("ordinal")), "ordinal", "left_anti").select("id", "type")
    removed = na.join(matched.select(F.col("a").alias("ordinal")), "ordinal", "left_anti").select("id", "type")

    part = components(matched.select("a", "b"))
    def ends(g: SupplyGraph, nodes: DataFrame, shift: int) -> DataFrame:
        place = nodes.select("id", "ordinal").join(part.select(F.col("node").alias("ordinal"), "component"), "ordinal", "left").groupBy("id").agg(F.max(F.coalesce("component", "ordinal")).alias("rep"))
        edges = g.edges if only.edge_types is None else g.edges.where(F.col("type").isin(only.edge_types))
        for end, name in (("source", "src"), ("target", "dst")):
            edges = edges.join(place.select(F.col("id").alias(end), F.col("rep").alias(name)), end)
        return edges.withColumn("ordinal", F.col("ordinal") + shift)

    ea, eb = ends(a, na, 0), ends(b, nb, move)
    cols = ["ordinal", "src", "dst", "type", "identifiers", "properties"]
    met = written(match_edges(ea.select(cols), eb.select(cols)), "edges")
    edge_pairs = met.join(ea.select(F.col("ordinal").alias("a"), F.col("id").alias("a_id"), F.col("properties").alias("x")), "a").join(eb.select(F.col("ordinal").alias("b"), F.col("id").alias("b_id"), F.col("properties").alias("y")), "b")
    edge_labels = label_changes(edge_pairs).select("a_id", "b_id", F.lit("labels").alias("field"), F.when(F.col("change") == "removed", F.concat_ws("=", "key", "value")).alias("old_value"), F.when(F.col("change") == "added", F.concat_ws("=", "key", "value")).alias("new_value"))
    return Diff(
        nodes_added=added,
        nodes_removed=removed,
        node_changes=changes(pairs, S.NODE_FIELDS, "x", "y", only.ignore),
        identifiers=identifier_changes(pairs),
        labels=label_changes(pairs),
        edges_added=eb.join(met.select(F.col("b").alias("ordinal")), "ordinal", "left_anti").select("id", "type"),
        edges_removed=ea.join(met.select(F.col("a").alias("ordinal")), "ordinal", "left_anti").select("id", "type"),
        edge_changes=changes(edge_pairs, S.PROPERTY_FIELDS, "x", "y", only.ignore).unionByName(edge_labels),
        matched=matched,
        edges_matched=met,
        warnings=warnings,
    )


def to_json(d: Diff) -> DataFrame:
    """One row for each change, as JSON; unchanged elements are left out."""
    rows = [
        d.nodes_added.select(F.lit("node_added").alias("kind"), F.struct("id", "type").alias("what")),
        d.nodes_removed.select(F.lit("node_removed").alias("kind"), F.struct("id", "type").alias("what")),
        d.edges_added.select(F.lit("edge_added").alias("kind"), F.struct("id", "type").alias("what")),
        d.edges_removed.select(F.lit("edge_removed").alias("kind"), F.struct("id", "type").alias("what")),
    ]
    out = None
    for r in rows:
        r = r.select("kind", F.to_json("what").alias("json"))
        out = r if out is None else out.unionByName(r)
    for kind, df in (("node_changed", d.node_changes), ("identifier", d.identifiers), ("label", d.labels), ("edge_changed", d.edge_changes)):
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json")))
    return out


def to_lines(d: Diff) -> DataFrame:
    """(line) for people to read: + and - for what is added and removed, ~ for what has changed."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = lambda c: F.coalesce(F.col(c), F.lit("none"))
    pair = F.when(F.col("a_id") == F.col("b_id"), F.col("a_id")).otherwise(F.concat_ws(" = ", "a_id", "b_id"))
    sign = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    changed = lambda what, df: df.select(text(f"~ {what} ", pair, ": ", F.col("field"), ": ", shown("old_value"), " -> ", shown("new_value")).alias("line"))
    rows = [df.select(text(f"{mark} {what} ", F.col("id"), " (", F.col("type"), ")").alias("line")) for mark, what, df in (("+", "node", d.nodes_added), ("-", "node", d.nodes_removed), ("+", "edge", d.edges_added), ("-", "edge", d.edges_removed))]
    rows += [changed("node", d.node_changes), changed("edge", d.edge_changes)]
    rows.append(d.identifiers.select(text("~ node ", pair, ": ", sign, " identifier ", F.col("canonical")).alias("line")))
    rows.append(d.labels.select(text("~ node ", pair, ": ", sign, " label ", F.concat_ws("=", "key", "value")).alias("line")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.substring("line", 3, 4), "line")
