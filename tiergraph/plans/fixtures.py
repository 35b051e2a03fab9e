"""Graphs with faults, and pairs of graphs to merge and compare, over the supplier table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.graph import SupplyGraph
from tiergraph.plans.bridge import SALT, header


def _keys(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


def _text(prefix: str, x):
    return F.concat(F.lit(prefix), x.cast("string"))


def faulty(spark: SparkSession, sf_dir: str) -> SupplyGraph:
    K = F.col("k")  # noqa: N806
    k, m, text = _keys(spark, sf_dir), K % 10, K.cast("string")
    scheme = F.element_at(F.array(*map(F.lit, ["", "lei", "duns", "gln", "vat", "nat-reg", "weird", "org.ext", "opaque", "internal"])), (m + 1).cast("int"))
    odd = K % 20 >= 10
    value = (
        F.when(m == 1, F.when(odd, "5493006MHB84DD0ZWV19").otherwise("5493006MHB84DD0ZWV18"))
        .when(m == 2, F.when(odd, "12345").otherwise(F.lpad(text, 9, "0")))
        .when(m == 3, F.when(odd, "4006381333932").otherwise("4006381333931"))
        .when((m == 7) & odd, "")
        .otherwise(text)
    )
    authority = F.when(m == 4, F.when(odd, "ZZ").otherwise("DE")).when((m == 5) & ~odd, "RA000001").when(m == 9, "erp")
    first = F.struct(
        scheme.alias("scheme"), value.alias("value"), authority.alias("authority"),
        F.when(K % 6 == 0, "2026-02-30").when(K % 6 == 1, "2025-05-01").alias("valid_from"), F.when(K % 6 == 1, "2024-01-01").alias("valid_to"), (K % 6 == 1).alias("valid_to_present"),
        F.when(K % 9 == 0, "confidential").alias("sensitivity"), F.lit(None).cast("string").alias("verification_status"), F.lit(None).cast("string").alias("verification_date"), F.lit(None).cast("string").alias("extra"),
    )
    idents = F.when(K % 13 == 0, None).when(K % 4 == 0, F.array(first, first)).otherwise(F.array(first))
    kind = F.when(K % 3 == 0, "organization").when(K % 3 == 1, "facility").otherwise("boundary_ref")
    twice = F.explode(F.when(K % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    nodes = k.select("k", twice).select((F.col("again") * 1_000_000 + K).alias("ordinal"), _text("N", K).alias("id"), kind.alias("type"), idents.alias("identifiers"), F.when(K % 8 == 1, _text("N", K - 1)).alias("operator"))
    types = F.element_at(F.array(*map(F.lit, ["supplies", "operates", "bogus", "com.ext", "ownership"])), (K % 5 + 1).cast("int"))
    again = F.explode(F.when(K % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    props = S.properties(percentage=F.lit(60.0), tier=F.when(K % 10 == 0, 1), valid_from=F.when(K % 10 == 4, "2020-01-01"))
    edges = k.select("k", again).select((F.col("again") * 1_000_000 + K).alias("ordinal"), _text("E", K).alias("id"), types.alias("type"), _text("N", K).alias("source"), _text("N", F.when(K % 5 == 4, F.floor(K / 20) * 3).otherwise(K * 2)).alias("target"), props.alias("properties"))
    return SupplyGraph(header(spark, disclosure_scope="partner", reporting_entity="N1"), S.conform(nodes, S.NODE), S.conform(edges, S.EDGE))


FAULTY_SQL = """
f_keys AS (SELECT s_suppkey AS k, s_suppkey % 10 AS m, s_suppkey % 20 >= 10 AS odd FROM supplier),
f_nodes AS (
  SELECT a * 1000000 + k AS ordinal, k, 'N' || k AS id, CASE k % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'facility' ELSE 'boundary_ref' END AS type,
    CASE WHEN k % 8 = 1 THEN 'N' || (k - 1) END AS operator
  FROM f_keys, range(2) t(a) WHERE a = 0 OR k % 7 = 0
), f_idents AS (
  SELECT ordinal, id, type, p AS pos,
    ['', 'lei', 'duns', 'gln', 'vat', 'nat-reg', 'weird', 'org.ext', 'opaque', 'internal'][(k % 10 + 1)::INT] AS scheme,
    CASE WHEN k % 10 = 1 THEN CASE WHEN k % 20 >= 10 THEN '5493006MHB84DD0ZWV19' ELSE '5493006MHB84DD0ZWV18' END
      WHEN k % 10 = 2 THEN CASE WHEN k % 20 >= 10 THEN '12345' ELSE lpad(k::VARCHAR, 9, '0') END
      WHEN k % 10 = 3 THEN CASE WHEN k % 20 >= 10 THEN '4006381333932' ELSE '4006381333931' END
      WHEN k % 10 = 7 AND k % 20 >= 10 THEN '' ELSE k::VARCHAR END AS value,
    CASE WHEN k % 10 = 4 THEN CASE WHEN k % 20 >= 10 THEN 'ZZ' ELSE 'DE' END WHEN k % 10 = 5 AND k % 20 < 10 THEN 'RA000001' WHEN k % 10 = 9 THEN 'erp' END AS authority,
    CASE k % 6 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2025-05-01' END AS valid_from, CASE WHEN k % 6 = 1 THEN '2024-01-01' END AS valid_to,
    CASE WHEN k % 9 = 0 THEN 'confidential' END AS sensitivity
  FROM f_nodes, range(2) t(p) WHERE k % 13 <> 0 AND (p = 0 OR k % 4 = 0)
), f_edges AS (
  SELECT a * 1000000 + k AS ordinal, k, 'E' || k AS id, ['supplies', 'operates', 'bogus', 'com.ext', 'ownership'][(k % 5 + 1)::INT] AS type, 'N' || k AS source,
    'N' || CASE WHEN k % 5 = 4 THEN k // 20 * 3 ELSE k * 2 END AS target, CASE WHEN k % 10 = 0 THEN 1 END AS tier, CASE WHEN k % 10 = 4 THEN '2020-01-01' END AS valid_from, 60.0 AS percentage
  FROM f_keys, range(2) t(a) WHERE a = 0 OR k % 11 = 0
)"""


def parties(spark: SparkSession, sf_dir: str) -> tuple[SupplyGraph, SupplyGraph]:
    """Two files that share suppliers from 40 to 70 % of the keys."""
    K = F.col("k")  # noqa: N806
    k = _keys(spark, sf_dir)
    n = k.agg(F.count("*").alias("n"))  # one row
    k = k.crossJoin(n)
    text = K.cast("string")
    out = []
    for part, (keep, prefix) in enumerate(((K < 0.7 * F.col("n"), "S"), (K >= 0.4 * F.col("n"), "T"))):
        mine = k.where(keep)
        low = F.lit(0) if part == 0 else F.ceil(0.4 * F.col("n"))
        second = S.identifier("internal", text, F.lit("erp")) if part == 0 else S.identifier("vat", text, F.lit("DE"))
        name = F.col("name") if part == 0 else F.when(K % 7 == 0, F.concat("name", F.lit(" Ltd"))).otherwise(F.col("name"))
        label = S.label("seen") if part == 0 else S.label("seen", F.lit("b"))
        nodes = mine.select(K.alias("ordinal"), _text(prefix, K).alias("id"), F.lit("organization").alias("type"), F.array(S.identifier("duns", F.lpad(text, 9, "0")), second).alias("identifiers"), name.alias("name"), F.lit("DE").alias("jurisdiction"), F.array(label, S.label("key", text)).alias("labels"))
        up = F.floor(K / 3)
        share = (K % 4 + 1) * 25 if part == 0 else F.when(K % 5 == 0, 1).otherwise((K % 4 + 1) * 25)
        edges = mine.where((K > 0) & (up >= low)).select(K.alias("ordinal"), _text("w", K).alias("id"), F.lit("ownership").alias("type"), _text(prefix, K).alias("source"), _text(prefix, up).alias("target"), S.properties(percentage=share, valid_from=F.when(K % 2 == 0, "2020-1-5" if part else "2020-01-05")).alias("properties"))
        out.append(SupplyGraph(header(spark, snapshot_date=f"2026-01-0{part + 1}", file_salt=SALT), S.conform(nodes, S.NODE), S.conform(edges, S.EDGE)))
    return out[0], out[1]


PARTIES_SQL = """
p_n AS (SELECT count(*) AS n FROM supplier),
p_nodes AS (
  SELECT 0 AS f, s_suppkey AS k, 'S' || s_suppkey AS id, s_name AS name FROM supplier, p_n WHERE s_suppkey < 0.7 * n
  UNION ALL SELECT 1, s_suppkey, 'T' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' Ltd' ELSE s_name END FROM supplier, p_n WHERE s_suppkey >= 0.4 * n
), p_edges AS (
  SELECT f, k, k // 3 AS up, CASE WHEN f = 1 AND k % 5 = 0 THEN 1 ELSE (k % 4 + 1) * 25 END::DOUBLE AS share
  FROM p_nodes, p_n WHERE k > 0 AND (f = 0 OR k // 3 >= ceil(0.4 * n))
)"""
