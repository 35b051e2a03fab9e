"""The queries of the graph operators, and the same as SQL for an independent engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.functions import expr as X
from tiergraph.operators import diff as D
from tiergraph.operators import inspect as I
from tiergraph.operators import merge as M
from tiergraph.operators import redact as R
from tiergraph.operators import subgraph as G
from tiergraph.operators import traverse as T
from tiergraph.operators import validate as V
from tiergraph.operators.select import Selectors, counts, match, parse, query
from tiergraph.plans.bridge import SALT, SQL, graph
from tiergraph.plans.fixtures import FAULTY_SQL, PARTIES_SQL, faulty, parties
from tiergraph.plans.shared import put, shared_dir
from tiergraph.sources import files, xlsx

QUERIES, ORACLES = {}, {}


def define(name: str, f, sql: str | None, prefix: str = SQL, recursive: bool = False) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{prefix} {sql}"


# -- selection ---------------------------------------------------------------
def _sel(name: str, selectors: Selectors, nodes: str | None, edges: str | None = None) -> None:
    def run(spark, sf_dir) -> DataFrame:
        n, e = match(graph(spark, sf_dir), selectors)
        return n.select("id", "type").unionByName(e.select("id", "type"))

    parts = [f"SELECT id, type FROM g_nodes WHERE {nodes}"] * bool(nodes) + [f"SELECT id, type FROM g_edges WHERE {edges}"] * bool(edges)
    define(name, run, " UNION ALL ".join(parts))


_sel("sel_node_type", Selectors(node_types=["facility", "good"]), "type IN ('facility', 'good')")
_sel("sel_edge_type", Selectors(edge_types=["supplies"]), None, "type = 'supplies'")
_sel("sel_label_key", Selectors(label_keys=["bulky"]), "id IN (SELECT id FROM g_labels WHERE key = 'bulky')")
_sel("sel_label_kv", Selectors(labels=[("segment", "BUILDING"), ("bulky", "x")]), "id IN (SELECT id FROM g_labels WHERE key = 'segment' AND value = 'BUILDING')")
_sel("sel_ident_scheme", Selectors(schemes=["vat"]), "id IN (SELECT id FROM g_idents WHERE scheme = 'vat')")
_sel("sel_ident_value", Selectors(identifiers=[("duns", "000000007"), ("internal", "3")]), "id IN (SELECT id FROM g_idents WHERE scheme = 'duns' AND value = '000000007' OR scheme = 'internal' AND value = '3')")
_sel("sel_jurisdiction", Selectors(jurisdictions=["FRANCE", "NATION_3", "GERMANY"]), "jurisdiction IN ('FRANCE', 'NATION_3', 'GERMANY')")
_sel("sel_name", Selectors(names=["00007", "STEEL"]), "lower(name) LIKE '%00007%' OR lower(name) LIKE '%steel%'")
_sel("sel_combined", Selectors(node_types=["organization"], schemes=["duns"], names=["1"]), "type = 'organization' AND name LIKE '%1%' AND id IN (SELECT id FROM g_idents WHERE scheme = 'duns')")
_sel("sel_parsed", parse(node_type=["good"], label=["bulky"], name=["a"]), "type = 'good' AND lower(name) LIKE '%a%' AND id IN (SELECT id FROM g_labels WHERE key = 'bulky')")
define("query_rows", lambda s, d: query(graph(s, d), Selectors(node_types=["facility"], edge_types=["ownership"])),
       "SELECT 'node' AS kind, id, type, coalesce(name, '') AS detail FROM g_nodes WHERE type = 'facility' UNION ALL SELECT 'edge', id, type, source || ' -> ' || target FROM g_edges WHERE type = 'ownership'")
define("query_counts", lambda s, d: counts(graph(s, d), Selectors(node_types=["organization"], edge_types=["produces", "operates"])),
       "SELECT 'node' AS kind, count(*) AS n FROM g_nodes WHERE type = 'organization' UNION ALL SELECT 'edge', count(*) FROM g_edges WHERE type IN ('produces', 'operates')")

# -- counts, lookups ---------------------------------------------------------
define("inspect_nodes", lambda s, d: I.node_counts(graph(s, d)), "SELECT type, count(*) AS n FROM g_nodes GROUP BY type")
define("inspect_edges", lambda s, d: I.edge_counts(graph(s, d)), "SELECT type, count(*) AS n FROM g_edges GROUP BY type")
define("inspect_identifiers", lambda s, d: I.identifier_counts(graph(s, d)), "SELECT scheme, count(*) AS n FROM g_idents GROUP BY scheme")
define("inspect_totals", lambda s, d: I.totals(graph(s, d)).select("version", "snapshot_date", "nodes", "edges"),
       "SELECT '0.1.0' AS version, '2026-01-01' AS snapshot_date, (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges")
define("ownership_sum", lambda s, d: I.owned(graph(s, d)), "SELECT target, sum(percentage) AS total FROM g_edges WHERE type = 'ownership' GROUP BY target")
define("canonical_ids", lambda s, d: graph(s, d).identifiers().select("id", "pos", "canonical"),
       "SELECT id, pos, CASE WHEN scheme IN ('nat-reg', 'vat') THEN scheme || ':' || coalesce(authority, '') || ':' || value ELSE scheme || ':' || value END AS canonical FROM g_idents")
define("orgs_per_jurisdiction", lambda s, d: match(graph(s, d), Selectors(node_types=["organization"]))[0].groupBy("jurisdiction").agg(F.count("*").alias("n")),
       "SELECT jurisdiction, count(*) AS n FROM g_nodes WHERE type = 'organization' GROUP BY jurisdiction")
define("neighbours_both", lambda s, d: graph(s, d).neighbours("S1", "both"), "SELECT target AS id FROM g_edges WHERE source = 'S1' UNION ALL SELECT source FROM g_edges WHERE target = 'S1'")
define("degree_in", lambda s, d: graph(s, d).edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")), "SELECT target AS id, count(*) AS n FROM g_edges GROUP BY target")


# -- traversal ---------------------------------------------------------------
def _reach(name: str, start: str, direction: str, kinds: tuple[str, ...], depth: int | None = None, cyclic: bool = False) -> None:
    listed = ", ".join(f"'{k}'" for k in kinds)
    edges = f"SELECT source, target FROM g_edges WHERE type IN ({listed})" if not cyclic else "SELECT source, target FROM g_cyclic"
    step = {"forward": "SELECT source AS x, target AS y FROM e", "backward": "SELECT target AS x, source AS y FROM e", "both": "SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e"}[direction]
    bound = 40 if depth is None else depth
    sql = f""", e AS ({edges}), a AS ({step}), r(id, depth) AS (SELECT '{start}', 0 UNION SELECT y, depth + 1 FROM r JOIN a ON x = id WHERE depth < {bound})
      SELECT id, min(depth)::BIGINT AS depth FROM r WHERE id <> '{start}' GROUP BY id"""
    if depth is None and direction != "forward":
        # Distances by rounds of a distinct frontier would repeat; the set alone is compared.
        sql = f", e AS ({edges}), a AS ({step}), r(id) AS (SELECT '{start}' UNION SELECT y FROM r JOIN a ON x = id) SELECT id FROM r WHERE id <> '{start}'"

    def run(spark, sf_dir):
        out = T.reachable(graph(spark, sf_dir, cyclic=cyclic), start, direction, list(kinds), depth)
        return out.select("id") if depth is None and direction != "forward" else out.select("id", F.col("depth").cast("long").alias("depth"))

    define(name, run, sql, recursive=True)


_reach("reach_fwd", "S9", "forward", ("ownership", "operates", "produces"))
_reach("reach_back", "S0", "backward", ("ownership",))
_reach("reach_both", "S5", "both", ("operates", "produces", "ownership"))
_reach("reach_filtered", "S9", "forward", ("supplies",))
_reach("reach_depth2", "S5", "both", ("operates", "produces", "ownership"), 2)
_reach("reach_depth0", "S5", "both", ("operates",), 0)
_reach("reach_from_cycle", "S0", "forward", ("ownership",), None, True)

_PATHS = """, e AS (SELECT source AS x, target AS y FROM g_edges WHERE type IN ('ownership', 'legal_parentage')),
  p(path, last) AS (SELECT ['S9'], 'S9' UNION ALL SELECT list_append(path, y), y FROM p JOIN e ON x = last WHERE last <> 'S0' AND NOT list_contains(path, y) AND len(path) <= 8)"""


def _shortest(spark, sf_dir):
    path = T.shortest_path(graph(spark, sf_dir), "S9", "S0", edge_types=["ownership", "legal_parentage"])
    return spark.createDataFrame([("->".join(path), len(path) - 1)], "path string, length long")


define("shortest_path", _shortest, _PATHS + " SELECT array_to_string(path, '->') AS path, len(path) - 1 AS length FROM p WHERE last = 'S0' ORDER BY len(path), path LIMIT 1", recursive=True)
define("all_paths", lambda s, d: T.all_paths(graph(s, d), "S9", "S0", 8, edge_types=["ownership", "legal_parentage"]).select(F.array_join("path", "->").alias("path")),
       _PATHS + " SELECT array_to_string(path, '->') AS path FROM p WHERE last = 'S0'", recursive=True)
define("all_paths_topk", lambda s, d: T.paths(graph(s, d, ("ownership", "legal_parentage")), "S9", "S0", 3, 8).select(F.array_join("path", "->").alias("path")),
       _PATHS + " SELECT array_to_string(path, '->') AS path FROM p WHERE last = 'S0' ORDER BY len(path), path LIMIT 3", recursive=True)
define("cycle_members", lambda s, d: T.cycle_components(graph(s, d, cyclic=True), ["ownership"]),
       """, r(a, b) AS (SELECT source, target FROM g_cyclic UNION SELECT a, target FROM r JOIN g_cyclic ON source = b)
       SELECT x.a AS id, min(y.b) AS component FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = y.a WHERE x.a = x.b GROUP BY x.a""", recursive=True)
define("cycles", lambda s, d: T.detect_cycles(graph(s, d, cyclic=True), ["ownership"]).select("component", F.size("cycle").cast("long").alias("length"), (F.col("cycle")[0] == F.element_at("cycle", -1)).alias("closed")), None)

# -- parts -------------------------------------------------------------------
_IN = "(SELECT id FROM g_nodes WHERE id IN ('S1', 'S2', 'S3', 'F1', 'F2', 'P1'))"


def _induced(spark, sf_dir):
    g = graph(spark, sf_dir)
    out = G.induced(g, g.nodes.where(F.col("id").isin("S1", "S2", "S3", "F1", "F2", "P1")))
    return out.nodes.select("id", "type").unionByName(out.edges.select("id", "type"))


define("induced", _induced, f"SELECT id, type FROM g_nodes WHERE id IN {_IN} UNION ALL SELECT id, type FROM g_edges WHERE source IN {_IN} AND target IN {_IN}")


def _around(name: str, make, seeds: str, hops: int) -> None:
    sql = f""", e AS (SELECT * FROM g_edges), a AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
      r(id, depth) AS ({seeds} UNION SELECT y, depth + 1 FROM r JOIN a ON x = id WHERE depth < {hops}), s AS (SELECT DISTINCT id FROM r)
      SELECT id, type FROM g_nodes WHERE id IN (FROM s) UNION ALL SELECT id, type FROM e WHERE source IN (FROM s) AND target IN (FROM s)"""

    def run(spark, sf_dir):
        out = make(graph(spark, sf_dir))
        return out.nodes.select("id", "type").unionByName(out.edges.select("id", "type"))

    define(name, run, sql, recursive=True)


_around("ego_r2", lambda g: G.ego(g, "S7", 2), "SELECT 'S7' AS id, 0 AS depth", 2)
_around("selector_subgraph_x1", lambda g: G.selected(g, Selectors(identifiers=[("duns", "000000003")], edge_types=["legal_parentage"]), 1),
        "SELECT 'S3' AS id, 0 AS depth UNION SELECT unnest([source, target]), 0 FROM g_edges WHERE type = 'legal_parentage'", 1)
_around("subgraph_ids", lambda g: G.subgraph(g, ["S2"], Selectors(node_types=["facility"], names=["none"]), 1, today="2026-01-01"), "SELECT 'S2' AS id, 0 AS depth", 1)

# -- validation --------------------------------------------------------------
_LEI = "list_reduce(list_concat([0::BIGINT], list_transform(string_split(value, ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT)), lambda acc, x: (CASE WHEN x > 9 THEN acc * 100 + x ELSE acc * 10 + x END) % 97)"
_GLN = "(10 - (list_sum(list_transform(range(1, 13), lambda i: substr(value, i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))::INT) % 10) % 10 = substr(value, 13, 1)::INT"
_NODE, _EDGE = "'node \"' || id || '\"'", "'edge \"' || id || '\"'"
_ID = _NODE + " || ' identifiers[' || pos || ']'"
_FIELD = lambda base, field: f"{base} || ' field \"{field}\"'"


def _rule(rule_id: str, sql: str, name: str | None = None) -> None:
    key = "val_" + rule_id.lower().replace("-", "_") if name is None else name
    external = V.External()
    define(key, lambda s, d: V.validate(faulty(s, d), (1, 2, 3), external, [rule_id]).select("rule_id", "severity", "location"),
           f"SELECT '{rule_id}' AS rule_id, '{V.SEVERITY[int(rule_id[1])]}' AS severity, location FROM ({sql})", FAULTY_SQL)


_TYPES, _SCHEMES = (", ".join(f"'{x}'" for x in xs) for xs in (S.EDGE_TYPES, S.CORE_SCHEMES))
_rule("L1-GDM-01", f"SELECT {_NODE} AS location FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS r FROM f_nodes) WHERE r > 1")
_rule("L1-GDM-02", f"SELECT {_EDGE} AS location FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS r FROM f_edges) WHERE r > 1")
_rule("L1-GDM-03", f"SELECT {_FIELD(_EDGE, 'source')} AS location FROM f_edges WHERE source NOT IN (SELECT id FROM f_nodes) UNION ALL SELECT {_FIELD(_EDGE, 'target')} FROM f_edges WHERE target NOT IN (SELECT id FROM f_nodes)")
_rule("L1-GDM-04", f"SELECT {_FIELD(_EDGE, 'type')} AS location FROM f_edges WHERE type NOT IN ({_TYPES}) AND type NOT LIKE '%.%'")
_rule("L1-GDM-05", "SELECT 'header.reporting_entity' AS location FROM (SELECT count(*) AS n FROM f_nodes WHERE id = 'N1' AND type = 'organization') WHERE n = 0")
_KIND = "(SELECT id AS n, any_value(type) AS kind FROM f_nodes GROUP BY id)"
_OK = "CASE type WHEN 'supplies' THEN 'organization' WHEN 'ownership' THEN 'organization' WHEN 'operates' THEN {} END"
_rule("L1-GDM-06", f"""SELECT {_FIELD(_EDGE, 'source')} AS location FROM f_edges JOIN {_KIND} ON n = source WHERE kind <> 'boundary_ref' AND kind <> {_OK.format("'organization'")}
  UNION ALL SELECT {_FIELD(_EDGE, 'target')} FROM f_edges JOIN {_KIND} ON n = target WHERE kind <> 'boundary_ref' AND kind <> {_OK.format("'facility'")}""")
_rule("L1-EID-01", f"SELECT {_ID} || '.scheme' AS location FROM f_idents WHERE scheme = ''")
_rule("L1-EID-02", f"SELECT {_ID} || '.value' AS location FROM f_idents WHERE value = ''")
_rule("L1-EID-03", f"SELECT {_ID} || '.authority' AS location FROM f_idents WHERE scheme IN ('nat-reg', 'vat', 'internal') AND coalesce(authority, '') = ''")
_rule("L1-EID-04", f"SELECT {_ID} || '.scheme' AS location FROM f_idents WHERE scheme NOT IN ('', {_SCHEMES}) AND scheme NOT LIKE '%.%'")
_rule("L1-EID-05", f"SELECT {_ID} || '.value' AS location FROM f_idents WHERE scheme = 'lei' AND (NOT regexp_matches(value, '^[A-Z0-9]{{18}}[0-9]{{2}}$') OR {_LEI} <> 1)")
_rule("L1-EID-06", f"SELECT {_ID} || '.value' AS location FROM f_idents WHERE scheme = 'duns' AND NOT regexp_matches(value, '^[0-9]{{9}}$')")
_rule("L1-EID-07", f"SELECT {_ID} || '.value' AS location FROM f_idents WHERE scheme = 'gln' AND (NOT regexp_matches(value, '^[0-9]{{13}}$') OR NOT {_GLN})")
_rule("L1-EID-08", f"SELECT {_ID} || '.valid_from' AS location FROM f_idents WHERE valid_from IS NOT NULL AND try_cast(valid_from AS DATE) IS NULL UNION ALL SELECT {_ID} || '.valid_to' FROM f_idents WHERE valid_to IS NOT NULL AND try_cast(valid_to AS DATE) IS NULL")
_rule("L1-EID-09", f"SELECT {_ID} || '.valid_from' AS location FROM f_idents WHERE valid_from > valid_to")
_rule("L1-EID-11", f"SELECT {_ID} AS location FROM (SELECT *, row_number() OVER (PARTITION BY ordinal, scheme, value, authority ORDER BY pos) AS r FROM f_idents) WHERE r > 1")
_rule("L1-SDI-01", f"""SELECT {_FIELD(_NODE, 'identifiers')} AS location FROM f_nodes LEFT JOIN (SELECT ordinal, count(*) AS n, min(scheme) AS scheme FROM f_idents GROUP BY ordinal) USING (ordinal)
  WHERE type = 'boundary_ref' AND (coalesce(n, 0) <> 1 OR scheme <> 'opaque')""")
_rule("L1-SDI-02", f"SELECT {_ID} || '.sensitivity' AS location FROM f_idents WHERE sensitivity = 'confidential'")
_rule("L2-GDM-01", f"""SELECT {_NODE} AS location FROM f_nodes WHERE type = 'facility' AND id NOT IN (
  SELECT x.id FROM f_nodes x JOIN f_nodes o ON o.id = x.operator AND o.type = 'organization'
  UNION SELECT target FROM f_edges JOIN f_nodes o ON o.id = source AND o.type = 'organization' WHERE f_edges.type IN ('operates', 'operational_control'))""")
_rule("L2-GDM-02", f"SELECT {_FIELD(_EDGE, 'valid_from')} AS location FROM f_edges WHERE type = 'ownership' AND valid_from IS NULL")
_rule("L2-GDM-03", f"SELECT {_FIELD(_NODE, 'data_quality')} AS location FROM f_nodes WHERE type IN ('organization', 'facility') UNION ALL SELECT {_FIELD(_EDGE, 'data_quality')} FROM f_edges WHERE type = 'supplies'")
_rule("L2-GDM-04", f"SELECT {_FIELD(_EDGE, 'tier')} AS location FROM f_edges WHERE false")
_rule("L2-EID-01", f"SELECT {_FIELD(_NODE, 'identifiers')} AS location FROM f_nodes WHERE type = 'organization' AND ordinal NOT IN (SELECT ordinal FROM f_idents WHERE scheme <> 'internal')")
_rule("L2-EID-04", f"SELECT {_ID} || '.authority' AS location FROM f_idents WHERE scheme = 'vat' AND authority = 'ZZ'")
_rule("L3-MRG-01", f"""SELECT {_NODE} AS location FROM f_nodes JOIN (SELECT target AS id, sum(percentage) AS t FROM f_edges WHERE type = 'ownership' AND source IN (SELECT id FROM f_nodes WHERE type = 'organization') GROUP BY target) USING (id) WHERE t > 100 AND type = 'organization'""")


def _lei_status(spark, sf_dir):
    ref = spark.createDataFrame([("5493006MHB84DD0ZWV18", "LAPSED")], "lei string, status string")
    return V.validate(faulty(spark, sf_dir), (3,), V.External(lei=ref), ["L3-EID-01"]).select("rule_id", "severity", "location")


define("val_l3_eid_01", _lei_status, f"SELECT 'L3-EID-01' AS rule_id, 'info' AS severity, {_ID} || '.value' AS location FROM f_idents WHERE value = '5493006MHB84DD0ZWV18'", FAULTY_SQL)
define("val_clean", lambda s, d: V.severity_counts(V.validate(graph(s, d), (1,))), "SELECT severity, n FROM (SELECT 'error' AS severity, 0 AS n) WHERE n > 0")


def _parent_cycles(spark, sf_dir):
    g = graph(spark, sf_dir)
    back = g.edges.where("id = 'lp:S2:S0'").selectExpr("*").withColumn("source", F.lit("S0")).withColumn("target", F.lit("S2")).withColumn("id", F.lit("lp:back"))
    g = type(g)(g.header, g.nodes, g.edges.unionByName(back))
    return V.validate(g, (3,), rules=["L3-MRG-02"])


define("val_l3_mrg_02", _parent_cycles, "SELECT 'L3-MRG-02' AS rule_id, 'info' AS severity, '(global)' AS location, 'legal_parentage goes round: S0 -> S2 -> S0' AS message", "x AS (SELECT 1)")


# -- merge -------------------------------------------------------------------
def _merged(spark, sf_dir) -> M.Merged:
    return M.merge(list(parties(spark, sf_dir)), check=False, salt=SALT, timestamp="2026-01-01T00:00:00Z", group_limit=1)


_MN = PARTIES_SQL + ", m AS (SELECT k, row_number() OVER (ORDER BY lpad(k::VARCHAR, 9, '0')) - 1 AS i, count(*) AS files, min(f) AS lo, max(f) AS hi, count(DISTINCT name) AS names, min(name) AS name FROM p_nodes GROUP BY k)"
define("merge_groups", lambda s, d: _sizes(s, d), "SELECT files AS size, count(*) AS n FROM m GROUP BY files", _MN)


def _sizes(spark, sf_dir):
    g = M.concat(list(parties(spark, sf_dir)))
    return M.groups(g).groupBy("rep").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


define("merge_nodes", lambda s, d: _merged(s, d).graph.nodes.select("id", "type", "name", "jurisdiction"),
       "SELECT 'n-' || i AS id, 'organization' AS type, CASE WHEN names = 1 THEN name END AS name, 'DE' AS jurisdiction FROM m", _MN)
define("merge_identifiers", lambda s, d: _merged(s, d).graph.identifiers().select("id", "pos", "canonical"),
       """SELECT id, row_number() OVER (PARTITION BY id ORDER BY canonical) - 1 AS pos, canonical FROM (
         SELECT 'n-' || i AS id, 'duns:' || lpad(k::VARCHAR, 9, '0') AS canonical FROM m UNION ALL SELECT 'n-' || i, 'internal:' || k FROM m WHERE lo = 0 UNION ALL SELECT 'n-' || i, 'vat:DE:' || k FROM m WHERE hi = 1)""", _MN)
define("merge_labels", lambda s, d: _merged(s, d).graph.node_labels(),
       "SELECT 'n-' || i AS id, 'key' AS key, k::VARCHAR AS value FROM m UNION ALL SELECT 'n-' || i, 'seen', NULL FROM m WHERE lo = 0 UNION ALL SELECT 'n-' || i, 'seen', 'b' FROM m WHERE hi = 1", _MN)
define("merge_conflicts", lambda s, d: _merged(s, d).conflicts, "SELECT 'n-' || i AS id, 'name' AS field, p.name AS value, 'file_' || f AS source_file FROM m JOIN p_nodes p USING (k) WHERE names > 1", _MN)
define("merge_edges", lambda s, d: _merged(s, d).graph.edges.select("type", "source", "target", F.col("properties.percentage").alias("percentage")),
       "SELECT DISTINCT 'ownership' AS type, 'n-' || a.i AS source, 'n-' || b.i AS target, share AS percentage FROM p_edges e JOIN m a ON a.k = e.k JOIN m b ON b.k = e.up", _MN)
define("merge_warnings", lambda s, d: _merged(s, d).warnings.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM m WHERE files > 1", _MN)
define("merge_header", lambda s, d: _merged(s, d).graph.header.select("version", "snapshot_date", "file_salt"), f"SELECT '0.1.0' AS version, '2026-01-02' AS snapshot_date, '{SALT}' AS file_salt", "x AS (SELECT 1)")
define("merge_metadata", lambda s, d: _merged(s, d).metadata.select(F.array_join("source_files", ",").alias("files"), "nodes", "edges", "timestamp"),
       "SELECT 'file_0,file_1' AS files, (SELECT count(*) FROM m) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT k, up, share FROM p_edges)) AS edges, '2026-01-01T00:00:00Z' AS timestamp", _MN)

# -- diff --------------------------------------------------------------------
_DN = PARTIES_SQL + ", x AS (SELECT * FROM p_nodes WHERE f = 0), y AS (SELECT * FROM p_nodes WHERE f = 1), ex AS (SELECT * FROM p_edges WHERE f = 0), ey AS (SELECT * FROM p_edges WHERE f = 1)"
define("diff_nodes_added", lambda s, d: D.diff(*parties(s, d)).nodes_added, "SELECT id, 'organization' AS type FROM y WHERE k NOT IN (SELECT k FROM x)", _DN)
define("diff_nodes_removed", lambda s, d: D.diff(*parties(s, d)).nodes_removed, "SELECT id, 'organization' AS type FROM x WHERE k NOT IN (SELECT k FROM y)", _DN)
define("diff_props", lambda s, d: D.diff(*parties(s, d)).node_changes, "SELECT x.id AS a_id, y.id AS b_id, 'name' AS field, x.name AS old_value, y.name AS new_value FROM x JOIN y USING (k) WHERE x.name <> y.name", _DN)
define("diff_idents", lambda s, d: D.diff(*parties(s, d)).identifiers, "SELECT x.id AS a_id, y.id AS b_id, 'vat:DE:' || k AS canonical, 'added' AS change FROM x JOIN y USING (k)", _DN)
define("diff_labels", lambda s, d: D.diff(*parties(s, d)).labels, "SELECT x.id AS a_id, y.id AS b_id, 'seen' AS key, NULL AS value, 'removed' AS change FROM x JOIN y USING (k) UNION ALL SELECT x.id, y.id, 'seen', 'b', 'added' FROM x JOIN y USING (k)", _DN)
define("diff_edges", lambda s, d: _edges_diff(s, d), """SELECT 'added' AS change, count(*) AS n FROM ey WHERE k IN (SELECT k FROM y) AND (k, up, share) NOT IN (SELECT k, up, share FROM ex)
       UNION ALL SELECT 'removed', count(*) FROM ex WHERE (k, up, share) NOT IN (SELECT k, up, share FROM ey) UNION ALL SELECT 'changed', 0""", _DN)


def _edges_diff(spark, sf_dir):
    d = D.diff(*parties(spark, sf_dir))
    rows = (("added", d.edges_added), ("removed", d.edges_removed), ("changed", d.edge_changes))
    out = None
    for name, df in rows:
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("change"), "n")
        out = part if out is None else out.unionByName(part)
    return out


define("diff_summary", lambda s, d: D.diff(*parties(s, d)).summary(), """, met AS (SELECT count(*) AS n FROM x JOIN y USING (k)), em AS (SELECT count(*) AS n FROM ex JOIN ey USING (k, up, share))
  SELECT (SELECT count(*) FROM y) - met.n AS nodes_added, (SELECT count(*) FROM x) - met.n AS nodes_removed, met.n AS nodes_modified, 0 AS nodes_unchanged,
  (SELECT count(*) FROM ey) - em.n AS edges_added, (SELECT count(*) FROM ex) - em.n AS edges_removed, 0 AS edges_modified, em.n AS edges_unchanged FROM met, em""", _DN)
define("diff_filtered", lambda s, d: D.diff(*parties(s, d), D.Filter(node_types=["organization"], edge_types=["supplies"], ignore=["name"])).summary().select("nodes_modified", "edges_added", "edges_removed"),
       "SELECT count(*) AS nodes_modified, 0 AS edges_added, 0 AS edges_removed FROM x JOIN y USING (k)", _DN)

# -- files -------------------------------------------------------------------
def _stored(spark, sf_dir, how: str):
    """The parties, written to files in the shared folder and read again."""
    from tiergraph import cli

    both = parties(spark, sf_dir)
    if how == "parquet":
        path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
        files.save_parquet(both[0], path)
        return files.load_parquet(spark, path)
    values = [files.to_value(g) for g in both]
    if how == "xlsx":
        return cli.graph_of(spark, xlsx.import_full(xlsx.read(xlsx.export_full(values[0])), salt=SALT))
    target, packed = how.split("+")[0], how.endswith("+zstd")
    return files.load(spark, put(spark, {f"{i}.{target}": files.encode(v, target, packed, pretty=i == 1 and target == "json") for i, v in enumerate(values)}))


_P0 = PARTIES_SQL + ", x AS (SELECT * FROM p_nodes WHERE f = 0), ex AS (SELECT * FROM p_edges WHERE f = 0)"
_READ_NODES = "SELECT f AS file_idx, id, 'organization' AS type, name, 'DE' AS jurisdiction FROM p_nodes"


def _read_nodes(how: str):
    return lambda s, d: _stored(s, d, how).nodes.select("file_idx", "id", "type", "name", F.lit("DE").alias("jurisdiction"))


define("files_json_labels", lambda s, d: _stored(s, d, "json").node_labels(), "SELECT id, 'key' AS key, k::VARCHAR AS value FROM p_nodes UNION ALL SELECT id, 'seen', CASE WHEN f = 1 THEN 'b' END FROM p_nodes", PARTIES_SQL)
define("files_json_header", lambda s, d: _stored(s, d, "json").header.select("file_idx", "version", "snapshot_date", "file_salt"),
       f"SELECT f AS file_idx, '0.1.0' AS version, '2026-01-0' || (f + 1) AS snapshot_date, '{SALT}' AS file_salt FROM range(2) t(f)", "x AS (SELECT 1)")
define("files_json_zstd_edges", lambda s, d: _stored(s, d, "json+zstd").edges.select("file_idx", "id", "type", "source", "target", "properties.percentage", "properties.valid_from"),
       """SELECT f AS file_idx, 'w' || k AS id, 'ownership' AS type, CASE f WHEN 0 THEN 'S' ELSE 'T' END || k AS source, CASE f WHEN 0 THEN 'S' ELSE 'T' END || up AS target, share AS percentage,
       CASE WHEN k % 2 = 0 THEN CASE f WHEN 1 THEN '2020-1-5' ELSE '2020-01-05' END END AS valid_from FROM p_edges""", PARTIES_SQL)
define("files_cbor_nodes", _read_nodes("cbor"), _READ_NODES, PARTIES_SQL)
define("files_cbor_zstd_idents", lambda s, d: _stored(s, d, "cbor+zstd").identifiers().select("id", "pos", "canonical"),
       "SELECT id, 0 AS pos, 'duns:' || lpad(k::VARCHAR, 9, '0') AS canonical FROM p_nodes UNION ALL SELECT id, 1, CASE f WHEN 0 THEN 'internal:' || k ELSE 'vat:DE:' || k END FROM p_nodes", PARTIES_SQL)
define("files_parquet_idents", lambda s, d: _stored(s, d, "parquet").identifiers().select("id", "pos", "canonical"),
       "SELECT id, 0 AS pos, 'duns:' || lpad(k::VARCHAR, 9, '0') AS canonical FROM x UNION ALL SELECT id, 1, 'internal:' || k FROM x", _P0)
define("files_parquet_edges", lambda s, d: _stored(s, d, "parquet").edges.select("id", "type", "source", "target", "properties.percentage"),
       "SELECT 'w' || k AS id, 'ownership' AS type, 'S' || k AS source, 'S' || up AS target, share AS percentage FROM ex", _P0)
define("files_xlsx_nodes", lambda s, d: _stored(s, d, "xlsx").nodes.select("id", "type", "name", "jurisdiction"), "SELECT id, 'organization' AS type, name, 'DE' AS jurisdiction FROM x", _P0)
define("files_xlsx_edges", lambda s, d: _stored(s, d, "xlsx").edges.select("type", "source", "target", "properties.percentage"),
       "SELECT 'ownership' AS type, 'S' || k AS source, 'S' || up AS target, share AS percentage FROM ex", _P0)

# -- redaction ---------------------------------------------------------------
_KEEP = "id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"


def _redacted(spark, sf_dir, scope: str = "partner"):
    g = graph(spark, sf_dir)
    keep = g.nodes.where("id like 'S%' and cast(substring(id, 2) as bigint) % 2 = 0").select("id")
    return g, R.redact(g, scope, keep, token=F.sha2("id", 256), check=False)


_HASH = f"sha256(encode('duns:' || lpad(substr(id, 2), 9, '0')) || unhex('{SALT}'))"
define("redact_nodes", lambda s, d: _redacted(s, d)[1].nodes.select("id", "type", "name"),
       f"SELECT id, CASE WHEN {_KEEP} THEN type ELSE 'boundary_ref' END AS type, CASE WHEN {_KEEP} THEN name END AS name FROM g_nodes")
define("redact_hash", lambda s, d: _redacted(s, d)[1].identifiers().where("type = 'boundary_ref'").select("id", "canonical"),
       f"SELECT id, 'opaque:' || CASE WHEN id LIKE 'S%' THEN {_HASH} ELSE sha256(id) END AS canonical FROM g_nodes WHERE NOT {_KEEP}")
define("redact_identifiers", lambda s, d: _redacted(s, d, "public")[1].identifiers().where("type <> 'boundary_ref'").select("id", "canonical"), f"SELECT id, 'duns:' || value AS canonical FROM g_idents WHERE scheme = 'duns' AND {_KEEP}")
define("redact_edges", lambda s, d: _redacted(s, d)[1].edges.select("id", "type"),
       f"SELECT e.id, type FROM g_edges e WHERE (source IN (SELECT id FROM g_nodes WHERE {_KEEP}) OR target IN (SELECT id FROM g_nodes WHERE {_KEEP}))")
define("redact_statistics", lambda s, d: R.statistics(*_redacted(s, d)),
       f"""SELECT count(*) FILTER ({_KEEP}) AS nodes_retained, count(*) FILTER (NOT {_KEEP}) AS boundary_refs, 0 AS nodes_omitted,
       (SELECT count(*) FROM g_edges e WHERE (source IN (SELECT id FROM g_nodes WHERE {_KEEP}) OR target IN (SELECT id FROM g_nodes WHERE {_KEEP}))) AS edges_retained,
       (SELECT count(*) FROM g_edges e WHERE NOT (source IN (SELECT id FROM g_nodes WHERE {_KEEP}) OR target IN (SELECT id FROM g_nodes WHERE {_KEEP}))) AS edges_omitted
       FROM g_nodes""")


def _redact_props(spark, sf_dir):
    g = graph(spark, sf_dir)
    g = type(g)(g.header, g.nodes, g.edges.where("type = 'ownership'"))  # the others have no such properties
    over = F.when(F.col("source").endswith("1"), '{"_property_sensitivity":{"percentage":"confidential"},"note":"x","n":5,"on":true,"o":{"k":1}}')
    props = S.properties(percentage=F.col("properties.percentage"), contract_ref=F.col("id"), volume=F.lit(2.0), volume_unit=F.lit("t"), extra=over)
    g = type(g)(g.header, g.nodes, g.edges.withColumn("properties", props))
    out = R.redact_edges(g, "public", g.nodes.select("id"))
    return out.select("id", *[F.col(f"properties.{c}").alias(c) for c in ("percentage", "contract_ref", "volume", "volume_unit", "extra")])


define("redact_props", _redact_props, """SELECT id, CASE WHEN source LIKE '%1' THEN NULL ELSE percentage END AS percentage, NULL AS contract_ref, NULL::DOUBLE AS volume, 't' AS volume_unit, CASE WHEN source LIKE '%1' THEN '{"note":"x","n":5,"on":true,"o":{"k":1}}' END AS extra FROM g_edges WHERE type = 'ownership'""")

# -- scalar functions --------------------------------------------------------
define("scalar_functions", lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(
    "s_suppkey", X.slug(F.concat("s_name", F.lit(" GmbH & Co."), F.lit("")), "org").alias("slug"), X.percent_encode(F.concat("s_name", F.lit("%:"))).alias("encoded"),
    X.normalised_date(F.concat(F.lit("2024-"), F.col("s_suppkey") % 12 + 1, F.lit("-5"))).alias("date"), X.ascii_lower(F.col("s_name")).alias("lower")),
    """SELECT s_suppkey, 'org-' || trim(regexp_replace(lower(s_name || ' GmbH & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(s_name, '%', '%25') || '%25%3A' AS encoded,
    '2024-' || lpad((s_suppkey % 12 + 1)::VARCHAR, 2, '0') || '-05' AS date, lower(s_name) AS lower FROM supplier""", "x AS (SELECT 1)")
