"""Validation rules: each gives a table of diagnostics, which are data and not errors.

A rule is a function from (graph, external) to rows of (rule_id, severity,
location, message) with two more columns for the order of the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.functions import expr as X
from tiergraph.graph import SupplyGraph

SEVERITY = {1: "error", 2: "warning", 3: "info"}


@dataclass(frozen=True)
class External:
    """Reference data from outside: (lei, status) and (authority, value, status)."""

    lei: DataFrame | None = None
    natreg: DataFrame | None = None

    def registered(self, identifiers: DataFrame) -> DataFrame:
        """The rows (authority, value, ...) that the national registers know, with their status.
        No rule uses it; a row without a record has no data, which is no fault."""
        if self.natreg is None:
            return identifiers.where(F.lit(False)).withColumn("status", F.lit(None).cast("string"))
        return identifiers.join(self.natreg.dropDuplicates(["authority", "value"]), ["authority", "value"])


RULES: dict[str, tuple[int, Callable[[SupplyGraph, External | None], DataFrame | None]]] = {}


def rule(rule_id: str):
    def keep(f):
        RULES[rule_id] = (int(rule_id[1]), f)
        return f

    return keep


def found(df: DataFrame, rule_id: str, location: Column, message: Column, first: Column | None = None, second: Column | None = None) -> DataFrame:
    none = F.lit(0).cast("long")
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(SEVERITY[int(rule_id[1])]).alias("severity"),
        location.alias("location"),
        message.alias("message"),
        (F.col("ordinal") if first is None else first).cast("long").alias("_first"),
        (none if second is None else second).cast("long").alias("_second"),
    )


def _quoted(kind: str, x: Column, field: str | None = None) -> Column:
    return F.concat(F.lit(f'{kind} "'), x, F.lit('"' + (f' field "{field}"' if field else "")))


def node_at(field: str | None = None) -> Column:
    return _quoted("node", F.col("id"), field)


def edge_at(field: str | None = None) -> Column:
    return _quoted("edge", F.col("id"), field)


def ident_at(field: str | None = None) -> Column:
    return F.concat(F.lit('node "'), F.col("id"), F.lit('" identifiers['), F.col("pos").cast("string"), F.lit("]" + (f".{field}" if field else "")))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _repeats(df: DataFrame) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))).where("_nth > 1")


@rule("L1-GDM-01")
def repeated_nodes(g, external=None):
    return found(_repeats(g.nodes.select("id", "ordinal")), "L1-GDM-01", node_at(), _said("node id is used again: ", F.col("id")))


@rule("L1-GDM-02")
def repeated_edges(g, external=None):
    return found(_repeats(g.edges.select("id", "ordinal")), "L1-GDM-02", edge_at(), _said("edge id is used again: ", F.col("id")))


@rule("L1-GDM-03")
def dangling(g, external=None):
    known = g.nodes.select(F.col("id").alias("_node")).distinct()
    ends = g.edges.select("id", "ordinal", F.posexplode(F.array("source", "target")).alias("_end", "_node")).join(known, "_node", "left_anti")
    field = F.when(F.col("_end") == 0, "source").otherwise("target")
    where = F.concat(edge_at(), F.lit(' field "'), field, F.lit('"'))
    return found(ends, "L1-GDM-03", where, _said(field, " is no node: ", F.col("_node")), second=F.col("_end"))


@rule("L1-GDM-04")
def unknown_edge_types(g, external=None):
    bad = g.edges.where(~F.col("type").isin(S.EDGE_TYPES) & ~F.col("type").contains("."))
    return found(bad, "L1-GDM-04", edge_at("type"), _said("neither a known edge type nor an extension: ", F.col("type")))


@rule("L1-GDM-05")
def reporting_entity(g, external=None):
    nodes = g.nodes.groupBy(F.col("id").alias("_id")).agg(F.min_by("type", "ordinal").alias("type"))
    bad = g.header.where("reporting_entity is not null").join(nodes, F.col("reporting_entity") == F.col("_id"), "left").where("type is null or type <> 'organization'")
    text = F.when(F.col("type").isNull(), _said("there is no such node: ", F.col("reporting_entity"))).otherwise(_said("not an organization but ", F.col("type"), ": ", F.col("reporting_entity")))
    return found(bad, "L1-GDM-05", F.lit("header.reporting_entity"), text, F.col("file_idx"))


@rule("L1-GDM-06")
def permitted_ends(g, external=None):
    spark = g.nodes.sparkSession
    rows = [(t, end, kinds[end]) for t, kinds in S.PERMITTED_ENDS.items() for end in (0, 1)]
    table = F.broadcast(spark.createDataFrame(rows, "type string, _end int, _allowed array<string>"))  # 30 fixed rows
    ends = g.edges.select("id", "ordinal", "type", F.posexplode(F.array("source", "target")).alias("_end", "_node")).join(table, ["type", "_end"])
    kinds = g.nodes.groupBy(F.col("id").alias("_node")).agg(F.max_by("type", "ordinal").alias("_kind"))
    exempt = F.col("_kind").isin([t for t in S.NODE_TYPES if t != "boundary_ref"])
    bad = ends.join(kinds, "_node").where(exempt & ~F.array_contains("_allowed", F.col("_kind")))
    field = F.when(F.col("_end") == 0, "source").otherwise("target")
    where = F.concat(edge_at(), F.lit(' field "'), field, F.lit('"'))
    text = _said(F.col("type"), " can't have ", F.col("_kind"), " as ", field, ", only ", F.array_join("_allowed", ", "))
    return found(bad, "L1-GDM-06", where, text, second=F.col("_end"))


def _idents(g: SupplyGraph, condition: Column) -> DataFrame:
    return g.identifiers().select("id", "type", "ordinal", "pos", "ident", "ident.*").where(condition)


def _ident_rule(rule_id: str, field: str | None, condition: Callable[[], Column], text: Callable[[], Column]):
    @rule(rule_id)
    def check(g, external=None):
        return found(_idents(g, condition()), rule_id, ident_at(field), text(), second=F.col("pos"))

    return check


_value = lambda: F.col("value")
_ident_rule("L1-EID-01", "scheme", lambda: F.col("scheme") == "", lambda: F.lit("the scheme is empty"))
_ident_rule("L1-EID-02", "value", lambda: F.col("value") == "", lambda: F.lit("the value is empty"))
_ident_rule(
    "L1-EID-03",
    "authority",
    lambda: F.col("scheme").isin(S.WITH_AUTHORITY) & (F.coalesce("authority", F.lit("")) == ""),
    lambda: _said("the scheme needs an authority: ", F.col("scheme")),
)
_ident_rule(
    "L1-EID-04",
    "scheme",
    lambda: (F.col("scheme") != "") & ~F.col("scheme").isin(S.CORE_SCHEMES) & ~F.col("scheme").contains("."),
    lambda: _said("neither a known scheme nor an extension: ", F.col("scheme")),
)
_ident_rule("L1-EID-05", "value", lambda: (F.col("scheme") == "lei") & ~X.lei_valid(F.col("value")), lambda: _said("not a LEI, or its check digits are wrong: ", _value()))
_ident_rule("L1-EID-06", "value", lambda: (F.col("scheme") == "duns") & ~F.col("value").rlike("^[0-9]{9}$"), lambda: _said("a DUNS has nine digits: ", _value()))
_ident_rule(
    "L1-EID-07",
    "value",
    lambda: (F.col("scheme") == "gln") & F.when(F.col("value").rlike("^[0-9]{13}$"), ~X.gs1_valid(F.col("value"))).otherwise(True),
    lambda: _said("not a GLN, or its check digit is wrong: ", _value()),
)


@rule("L1-EID-08")
def real_dates(g, external=None):
    rows = g.identifiers().select("id", "ordinal", "pos", F.posexplode(F.array("ident.valid_from", "ident.valid_to")).alias("_end", "_date"))
    bad = rows.where(F.col("_date").isNotNull() & ~X.real_date(F.col("_date")))
    field = F.when(F.col("_end") == 0, "valid_from").otherwise("valid_to")
    return found(bad, "L1-EID-08", F.concat(ident_at(), F.lit("."), field), _said("no day of the calendar: ", F.col("_date")), second=F.col("pos") * 2 + F.col("_end"))


_ident_rule("L1-EID-09", "valid_from", lambda: F.col("valid_from") > F.col("valid_to"), lambda: _said("valid from ", F.col("valid_from"), ", after ", F.col("valid_to")))


@rule("L1-EID-11")
def repeated_identifiers(g, external=None):
    rows = g.identifiers().select("id", "ordinal", "pos", "ident.scheme", "ident.value", "ident.authority")
    nth = F.row_number().over(Window.partitionBy("ordinal", "scheme", "value", "authority").orderBy("pos"))
    bad = rows.withColumn("_nth", nth).where("_nth > 1")
    return found(bad, "L1-EID-11", ident_at(), _said("the node has the identifier twice: ", F.col("scheme"), ":", F.col("value")), second=F.col("pos"))


@rule("L1-SDI-01")
def boundary_refs(g, external=None):
    stub = g.nodes.where("type = 'boundary_ref'").withColumn("_n", F.when(F.col("identifiers").isNull(), -1).otherwise(F.size("identifiers")))
    count = found(stub.where("_n <> 1"), "L1-SDI-01", node_at("identifiers"), _said("needs one identifier, has ", F.when(F.col("_n") < 0, "none").otherwise(F.col("_n").cast("string"))))
    other = stub.where((F.col("_n") == 1) & (F.col("identifiers")[0]["scheme"] != "opaque"))
    kind = found(other, "L1-SDI-01", node_at("identifiers"), _said("its identifier must be opaque, not ", F.col("identifiers")[0]["scheme"]), second=F.lit(1))
    return count.unionByName(kind)


@rule("L1-SDI-02")
def scope_of_identifiers(g, external=None):
    rows = g.identifiers().withColumn("_level", X.sensitivity(F.col("ident"), F.col("type")))
    scope = g.header.agg(F.min_by("disclosure_scope", "file_idx").alias("_scope"))  # one row
    bad = rows.crossJoin(scope).where("_scope = 'public' and _level <> 'public' or _scope = 'partner' and _level = 'confidential'")
    return found(bad, "L1-SDI-02", ident_at("sensitivity"), _said(F.col("_level"), " is not for scope ", F.col("_scope")), second=F.col("pos"))


@rule("L2-GDM-01")
def lone_facilities(g, external=None):
    org = g.nodes.where("type = 'organization'").select(F.col("id").alias("_org")).distinct()
    by_field = g.nodes.where("type = 'facility' and operator is not null").select(F.col("operator").alias("_org"), F.col("id").alias("_fac"))
    out = g.edges.where("type in ('operates', 'operational_control')").select(F.col("source").alias("_org"), F.col("target").alias("_fac"))
    tolls = g.edges.where("type = 'tolls'").select(F.col("target").alias("_org"), F.col("source").alias("_fac"))
    held = by_field.unionByName(out).unionByName(tolls).join(org, "_org", "left_semi").select(F.col("_fac").alias("id")).distinct()
    return found(g.nodes.where("type = 'facility'").join(held, "id", "left_anti"), "L2-GDM-01", node_at(), F.lit("no organization is connected with the facility"))


@rule("L2-GDM-02")
def undated_ownership(g, external=None):
    return found(g.edges.where("type = 'ownership' and properties.valid_from is null"), "L2-GDM-02", edge_at("valid_from"), F.lit("an ownership should say since when"))


@rule("L2-GDM-03")
def without_quality(g, external=None):
    nodes = found(g.nodes.where("type in ('organization', 'facility') and data_quality is null"), "L2-GDM-03", node_at("data_quality"), F.lit("nothing says how good the data are"))
    edges = found(g.edges.where("type in ('supplies', 'subcontracts', 'tolls') and properties.data_quality is null"), "L2-GDM-03", edge_at("data_quality"), F.lit("nothing says how good the data are"), second=F.lit(1))
    return nodes.unionByName(edges)


@rule("L2-GDM-04")
def tier_without_entity(g, external=None):
    none = g.header.agg(F.count("reporting_entity").alias("_n")).where("_n = 0")  # one row at most
    return found(g.edges.where("type = 'supplies' and properties.tier is not null").crossJoin(none), "L2-GDM-04", edge_at("tier"), F.lit("a tier says little without a reporting entity"))


@rule("L2-EID-01")
def unidentified(g, external=None):
    some = F.coalesce(F.exists("identifiers", lambda x: x["scheme"] != "internal"), F.lit(False))
    return found(g.nodes.where((F.col("type") == "organization") & ~some), "L2-EID-01", node_at("identifiers"), F.lit("only internal identifiers, or none"))


@rule("L2-EID-04")
def vat_country(g, external=None):
    codes = S.country_codes(g.nodes.sparkSession)
    bad = _idents(g, (F.col("scheme") == "vat") & ~F.col("authority").isin(codes))
    return found(bad, "L2-EID-04", ident_at("authority"), _said("no country code: ", F.col("authority")), second=F.col("pos"))


@rule("L3-EID-01")
def inactive_lei(g, external=None):
    if external is None or external.lei is None:
        return None
    rows = _idents(g, F.col("scheme") == "lei").join(external.lei.select(F.col("lei").alias("value"), F.col("status").alias("_status")), "value")
    return found(rows.where("_status in ('LAPSED', 'RETIRED', 'ANNULLED')"), "L3-EID-01", ident_at("value"), _said("the LEI is ", F.col("_status")), second=F.col("pos"))


@rule("L3-MRG-01")
def oversold(g, external=None):
    if external is None:
        return None
    org = g.nodes.where("type = 'organization'").select("id", "ordinal")
    rows = g.edges.where("type = 'ownership' and properties.percentage is not null").join(org.select(F.col("id").alias("source")), "source", "left_semi")
    total = rows.groupBy(F.col("target").alias("id")).agg(F.sum("properties.percentage").alias("_total")).where("_total > 100").join(org, "id")
    return found(total, "L3-MRG-01", node_at(), _said("owned to ", F.format_number("_total", 2), " %"))


@rule("L3-MRG-02")
def parent_cycles(g, external=None):
    from tiergraph.operators.traverse import detect_cycles

    if found_faults(g, ["L1-GDM-01", "L1-GDM-03"]):
        return None
    cycles = detect_cycles(g, ["legal_parentage"])
    return found(cycles.withColumn("ordinal", F.lit(0)), "L3-MRG-02", F.lit("(global)"), _said("legal_parentage goes round: ", F.array_join("cycle", " -> ")))


def found_faults(g: SupplyGraph, rules: list[str]) -> bool:
    return any(RULES[r][1](g, None).limit(1).count() for r in rules)


def validate(g: SupplyGraph, levels: tuple[int, ...] = (1, 2), external: External | None = None, rules: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """(rule_id, severity, location, message) of all rules of the levels; ``ordered``:
    by rule, then as in the file."""
    out = None
    for rule_id, (level, check) in RULES.items():
        if level in levels and (rules is None or rule_id in rules):
            part = check(g, external)
            if part is not None:
                out = part if out is None else out.unionByName(part)
    if out is None:
        return g.nodes.sparkSession.createDataFrame([], S.DIAGNOSTIC)
    if ordered:
        rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule_id"))
        out = out.orderBy(rank, "_first", "_second")
    return out.select("rule_id", "severity", "location", "message")


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count("*").alias("n"))


def is_valid(g: SupplyGraph) -> bool:
    """Whether no rule of level 1 finds anything."""
    return not validate(g, (1,)).limit(1).count()
