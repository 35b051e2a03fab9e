"""A supply graph over the tables of the test data, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.graph import SupplyGraph

SALT = "00112233445566778899aabbccddeeff" * 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def header(spark: SparkSession, **given) -> DataFrame:
    row = {"file_idx": 0, "version": "0.1.0", "snapshot_date": "2026-01-01", "file_salt": SALT} | given
    return spark.range(1).select(*[F.lit(row.get(k)).cast(t).alias(k) for k, t in S.HEADER.items()])


def _nodes(spark, sf_dir) -> list[DataFrame]:
    nation = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # a fixed set of 25
    s, c, p, o = (_read(spark, sf_dir, t) for t in ("supplier", "customer", "part", "orders"))
    key = F.col("s_suppkey").cast("string")
    idents = F.array(
        S.identifier("duns", F.lpad(key, 9, "0")),
        S.identifier("internal", key, F.lit("erp")),
        S.identifier("vat", key, F.when(F.col("s_suppkey") % 5 == 0, "XX").otherwise("DE")),
    )
    place = lambda kind, k: (F.col(k) * 8 + kind).alias("ordinal")
    text = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string")).alias("id")
    return [
        s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(place(0, "s_suppkey"), text("S", "s_suppkey"), F.lit("organization").alias("type"), F.col("s_name").alias("name"), F.col("n_name").alias("jurisdiction"), idents.alias("identifiers")),
        c.join(nation, c["c_nationkey"] == nation["n_nationkey"]).select(place(1, "c_custkey"), text("C", "c_custkey"), F.lit("organization").alias("type"), F.col("c_name").alias("name"), F.col("n_name").alias("jurisdiction"), F.array(S.label("segment", F.col("c_mktsegment"))).alias("labels")),
        s.select(place(2, "s_suppkey"), text("F", "s_suppkey"), F.lit("facility").alias("type"), F.concat(F.lit("S"), key).alias("operator")),
        p.select(place(3, "p_partkey"), text("P", "p_partkey"), F.lit("good").alias("type"), F.col("p_name").alias("name"),
            F.concat(F.array(S.label("brand", F.col("p_brand")), S.label("type", F.col("p_type"))), F.when(F.col("p_size") > 25, F.array(S.label("bulky"))).otherwise(F.array().cast(f"array<{S.LABEL}>"))).alias("labels")),
        o.select(place(4, "o_orderkey"), text("O", "o_orderkey"), F.lit("consignment").alias("type")),
    ]


def _edges(spark, sf_dir, cyclic: bool) -> list[DataFrame]:
    line, orders, s = (_read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))

    def edge(df: DataFrame, kind: str, source, target, **props) -> DataFrame:
        short = {"supplies": "su", "operates": "op", "produces": "pr", "composed_of": "co", "ownership": "ow", "legal_parentage": "lp"}[kind]
        ident = F.concat(F.lit(short + ":"), source, F.lit(":"), target)
        return df.select(ident.alias("id"), F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), S.properties(**props).alias("properties"))

    at = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    k = F.col("s_suppkey")
    up = lambda n: F.concat(F.lit("S"), F.floor(k / n).cast("string"))
    out = [
        edge(line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_suppkey", "o_custkey").distinct(), "supplies", at("S", "l_suppkey"), at("C", "o_custkey")),
        edge(s, "operates", at("S", "s_suppkey"), at("F", "s_suppkey")),
        edge(line.select("l_suppkey", "l_partkey").distinct(), "produces", at("F", "l_suppkey"), at("P", "l_partkey")),
        edge(line.select("l_orderkey", "l_partkey").distinct(), "composed_of", at("O", "l_orderkey"), at("P", "l_partkey")),
        edge(s.where("s_suppkey > 0"), "ownership", at("S", "s_suppkey"), up(3), percentage=((k % 4) + 1) * 25),
        edge(s.where("s_suppkey > 0"), "legal_parentage", at("S", "s_suppkey"), up(4)),
    ]
    if cyclic:
        last = s.agg(F.max("s_suppkey").alias("s_suppkey"))
        out.append(edge(last, "ownership", F.lit("S0"), at("S", "s_suppkey"), percentage=F.lit(10)))
    return out


def graph(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None, cyclic: bool = False) -> SupplyGraph:
    """``kinds``: only edges of these types are made."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir, cyclic)
    every = ["supplies", "operates", "produces", "composed_of", "ownership", "legal_parentage", "ownership"]
    edges = [e for e, k in zip(edges, every, strict=False) if kinds is None or k in kinds]
    union = lambda parts, fields: _union([S.conform(p, fields) for p in parts])
    return SupplyGraph(header(spark), union(nodes, S.NODE), union(edges, S.EDGE))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same graph for an independent engine: nodes, identifiers, labels, edges.
SQL = """
g_nodes AS (
  SELECT s_suppkey * 8 AS ordinal, 'S' || s_suppkey AS id, 'organization' AS type, s_name AS name, n_name AS jurisdiction, NULL AS operator FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey * 8 + 1, 'C' || c_custkey, 'organization', c_name, n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey * 8 + 2, 'F' || s_suppkey, 'facility', NULL, NULL, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT p_partkey * 8 + 3, 'P' || p_partkey, 'good', p_name, NULL, NULL FROM part
  UNION ALL SELECT o_orderkey * 8 + 4, 'O' || o_orderkey, 'consignment', NULL, NULL, NULL FROM orders
), g_idents AS (
  SELECT 'S' || s_suppkey AS id, 0 AS pos, 'duns' AS scheme, lpad(s_suppkey::VARCHAR, 9, '0') AS value, NULL AS authority FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 1, 'internal', s_suppkey::VARCHAR, 'erp' FROM supplier
  UNION ALL SELECT 'S' || s_suppkey, 2, 'vat', s_suppkey::VARCHAR, CASE WHEN s_suppkey % 5 = 0 THEN 'XX' ELSE 'DE' END FROM supplier
), g_labels AS (
  SELECT 'C' || c_custkey AS id, 'segment' AS key, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 'P' || p_partkey, 'type', p_type FROM part
  UNION ALL SELECT 'P' || p_partkey, 'bulky', NULL FROM part WHERE p_size > 25
), g_edges AS (
  SELECT 'su:' || source || ':' || target AS id, 'supplies' AS type, source, target, NULL::DOUBLE AS percentage FROM (SELECT DISTINCT 'S' || l_suppkey AS source, 'C' || o_custkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  UNION ALL SELECT 'op:S' || s_suppkey || ':F' || s_suppkey, 'operates', 'S' || s_suppkey, 'F' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'pr:' || source || ':' || target, 'produces', source, target, NULL FROM (SELECT DISTINCT 'F' || l_suppkey AS source, 'P' || l_partkey AS target FROM lineitem)
  UNION ALL SELECT 'co:' || source || ':' || target, 'composed_of', source, target, NULL FROM (SELECT DISTINCT 'O' || l_orderkey AS source, 'P' || l_partkey AS target FROM lineitem)
  UNION ALL SELECT 'ow:S' || s_suppkey || ':S' || s_suppkey // 3, 'ownership', 'S' || s_suppkey, 'S' || s_suppkey // 3, (s_suppkey % 4 + 1) * 25.0 FROM supplier WHERE s_suppkey > 0
  UNION ALL SELECT 'lp:S' || s_suppkey || ':S' || s_suppkey // 4, 'legal_parentage', 'S' || s_suppkey, 'S' || s_suppkey // 4, NULL FROM supplier WHERE s_suppkey > 0
), g_cyclic AS (
  SELECT source, target FROM g_edges WHERE type = 'ownership' UNION ALL SELECT 'S0', 'S' || max(s_suppkey) FROM supplier
)"""
