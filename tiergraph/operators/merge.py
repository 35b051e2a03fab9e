"""Merging snapshots of several parties by the identifiers of their nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph import schema as S
from tiergraph.components import components
from tiergraph.functions import expr as X
from tiergraph.graph import ArgumentError, InvalidOutput, SupplyGraph
from tiergraph.plans.shared import written

CONFIDENCE = ["possible", "probable", "definite"]


@dataclass(frozen=True)
class Merged:
    graph: SupplyGraph
    warnings: DataFrame  # (component, size) of groups over the limit
    conflicts: DataFrame  # (id, field, value, source_file)
    metadata: DataFrame  # one row


def concat(graphs: list[SupplyGraph]) -> SupplyGraph:
    """All files as one table; ordinals follow the order of files, then of rows."""
    parts = []
    for i, g in enumerate(graphs):
        at = lambda df, i=i: df.withColumn("file_idx", F.lit(i)).withColumn("ordinal", F.lit(i << 40) + F.coalesce("ordinal", F.lit(0)))
        parts.append(SupplyGraph(g.header.withColumn("file_idx", F.lit(i)), at(g.nodes), at(g.edges)))
    out = parts[0]
    for p in parts[1:]:
        out = SupplyGraph(out.header.unionByName(p.header), out.nodes.unionByName(p.nodes), out.edges.unionByName(p.edges))
    return out


def identity_rows(nodes: DataFrame) -> DataFrame:
    """(ordinal, ident, canonical) of what can identify a node: not internal, not annulled."""
    rows = nodes.select("ordinal", F.explode("identifiers").alias("ident"))
    rows = rows.where((F.col("ident.scheme") != "internal") & ~X.annulled(F.col("ident")))
    return rows.withColumn("canonical", X.canonical(F.col("ident")))


def node_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of ordinals: nodes that share a canonical identifier and have a matching pair.

    Nodes that share the identifier with all its fields are linked with the first of
    them, so a popular identifier costs a row for each; the others of a bucket are
    compared pair by pair."""
    rows = identity_rows(nodes)
    same = F.struct("canonical", "ident.scheme", "ident.value", X.ascii_lower(F.col("ident.authority")).alias("authority"), "ident.valid_from", "ident.valid_to", "ident.valid_to_present")
    alike = X.identifiers_match(F.col("ident"), F.col("ident"))
    rows = rows.select("ordinal", "canonical", F.xxhash64(same, F.when(~alike, F.col("ordinal"))).alias("_same")).distinct()
    first = rows.groupBy("canonical", "_same").agg(F.min("ordinal").alias("_first"))
    stars = rows.join(first, ["canonical", "_same"]).select(F.col("_first").alias("a"), F.col("ordinal").alias("b")).where("a <> b")
    kinds = first.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1")
    mixed = rows.join(kinds, "canonical", "left_semi")
    pairs = mixed.alias("x").join(mixed.alias("y"), "canonical").where("x.ordinal < y.ordinal and x._same <> y._same").select(F.col("x.ordinal").alias("a"), F.col("y.ordinal").alias("b")).distinct()
    ids = nodes.select("ordinal", "identifiers")
    tested = pairs.join(ids.select(F.col("ordinal").alias("a"), F.col("identifiers").alias("ia")), "a").join(ids.select(F.col("ordinal").alias("b"), F.col("identifiers").alias("ib")), "b")
    return stars.unionByName(tested.where(X.any_match(F.col("ia"), F.col("ib"))).select("a", "b")).distinct()


def same_as_links(g: SupplyGraph, threshold: str = "definite") -> DataFrame:
    """Links of same_as edges whose confidence reaches the threshold, ends in their own file."""
    said = F.coalesce(F.get_json_object("properties.extra", "$.confidence"), F.get_json_object("extra", "$.confidence"), F.lit("possible"))
    enough = said.isin(CONFIDENCE[CONFIDENCE.index(threshold) :])
    place = g.nodes.groupBy("file_idx", "id").agg(F.min("ordinal").alias("ordinal"))
    edges = g.edges.where((F.col("type") == "same_as") & enough)
    for end, name in (("source", "a"), ("target", "b")):
        edges = edges.join(place.select("file_idx", F.col("id").alias(end), F.col("ordinal").alias(name)), ["file_idx", end])
    return edges.select("a", "b")


def groups(g: SupplyGraph, threshold: str = "definite") -> DataFrame:
    """(ordinal, rep): each node with the first of the nodes that are the same as it."""
    part = components(node_links(g.nodes).unionByName(same_as_links(g, threshold)))
    out = g.nodes.select("ordinal").join(part.select(F.col("node").alias("ordinal"), "component"), "ordinal", "left")
    return out.select("ordinal", F.coalesce("component", "ordinal").alias("rep"))


def numbered(df: DataFrame, keys: list[str], name: str, prefix: str) -> DataFrame:
    """A text id by the order of the keys, without bringing all rows to one task:
    ranges are sorted, and each gets the number of rows before it."""
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    total, offsets = 0, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        offsets.append((r["_range"], total))
        total += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_range int, _offset long"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_nth", nth).join(offset, "_range").withColumn(name, F.concat(F.lit(prefix), (F.col("_nth") + F.col("_offset")).cast("string"))).drop("_range", "_nth", "_offset")


def merged_identifiers(rows: DataFrame) -> DataFrame:
    """(rep, identifiers) from (rep, ordinal, identifiers): the first of each canonical form, by it."""
    each = rows.select("rep", "ordinal", F.posexplode("identifiers").alias("_pos", "ident")).withColumn("canonical", X.canonical(F.col("ident")))
    one = each.groupBy("rep", "canonical").agg(F.min_by("ident", F.struct("ordinal", "_pos")).alias("ident"))
    listed = one.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "ident"))).alias("_m"))
    return listed.select("rep", F.transform(F.array_sort(F.map_keys("_m")), lambda k: F.col("_m")[k]).alias("identifiers"))


def merged_labels(rows: DataFrame) -> DataFrame:
    """(rep, labels) from (rep, labels): each (key, value) once, by key, without a value first."""
    each = rows.select("rep", F.explode("labels").alias("l"))
    key = F.struct(F.col("l.key").alias("key"), F.col("l.value").isNotNull().alias("has"), F.coalesce("l.value", F.lit("")).alias("value"))
    listed = each.groupBy("rep").agg(F.array_sort(F.collect_set(key)).alias("_l"))
    return listed.select("rep", F.transform("_l", lambda x: F.struct(x["key"].alias("key"), F.when(x["has"], x["value"]).alias("value"))).alias("labels"))


def scalar_conflicts(nodes: DataFrame, fields: tuple[str, ...] = ("name", "jurisdiction", "status")) -> DataFrame:
    """(rep, field, value, source_file) of fields with different values in a group."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = nodes.select("rep", "file_idx", F.explode(pairs).alias("p")).select("rep", "p.field", "p.value", F.concat(F.lit("file_"), F.col("file_idx").cast("string")).alias("source_file")).where("value is not null")
    many = rows.groupBy("rep", "field").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).where("_lo <> _hi")
    return rows.join(many.select("rep", "field"), ["rep", "field"], "left_semi").distinct()


def merge_nodes(g: SupplyGraph, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their old rep, conflicts)."""
    nodes = g.nodes.join(grouped, "ordinal")
    ids = identity_rows(g.nodes).join(grouped, "ordinal")
    first_id = ids.groupBy("rep").agg(F.min("canonical").alias("_canonical"))
    plain = [c for c in S.NODE if c not in ("file_idx", "ordinal", "id", "identifiers", "labels", "name", "jurisdiction", "status", "data_quality", "extra")]
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    base = nodes.groupBy("rep").agg(F.min_by(F.struct(*plain), "ordinal").alias("_first"), *[agreed(c) for c in ("name", "jurisdiction", "status")])
    conflicts = scalar_conflicts(nodes)
    told = conflicts.groupBy("rep", "field").agg(F.array_sort(F.collect_set(F.struct("source_file", "value"))).alias("_v"))
    told = told.select("rep", F.struct("field", F.transform("_v", lambda x: F.struct(x["value"].alias("value"), x["source_file"].alias("source_file"))).alias("values")).alias("_c"))
    told = told.groupBy("rep").agg(F.to_json(F.struct(F.array_sort(F.collect_list("_c")).alias("_conflicts"))).alias("extra"))
    out = base.join(first_id, "rep", "left").join(merged_identifiers(nodes), "rep", "left").join(merged_labels(nodes), "rep", "left").join(told, "rep", "left")
    out = out.withColumn("_canonical", F.coalesce("_canonical", F.lit("")))
    out = numbered(out, ["_canonical", "rep"], "id", "n-")
    out = out.select("*", "_first.*").drop("_first").withColumn("ordinal", F.col("rep")).withColumn("file_idx", F.lit(0))
    return S.conform(out, S.NODE | {"rep": "bigint", "_canonical": "string"}), conflicts.join(out.select("rep", "id"), "rep").select("id", "field", "value", "source_file")


def edge_identity(kind: Column, props: Column) -> Column:
    """What two edges of a type between the same nodes must agree in."""
    fields = {
        "ownership": ("percentage", "direct"),
        "operational_control": ("control_type",),
        "legal_parentage": ("consolidation_basis",),
        "former_identity": ("event_type", "effective_date"),
        "beneficial_ownership": ("control_type", "percentage"),
        "supplies": ("commodity", "contract_ref"),
        "subcontracts": ("commodity", "contract_ref"),
        "sells_to": ("commodity", "contract_ref"),
        "tolls": ("commodity",),
        "brokers": ("commodity",),
        "distributes": ("service_type",),
        "attested_by": ("scope",),
    }
    out = F.lit("")
    for name, own in fields.items():
        text = F.to_json(F.struct(*[X.bits(props[c]).alias(c) for c in own]))
        out = F.when(kind == name, text).otherwise(out)
    return out


def externals(identifiers: Column) -> Column:
    return F.filter(F.coalesce(identifiers, F.array()), lambda x: x["scheme"] != "internal")


def edge_links(edges: DataFrame) -> DataFrame:
    """(a, b) of ordinals of equal edges, from (ordinal, src, dst, type, identifiers,
    properties). Edges with external identifiers must share one; others must agree in what identifies
    them, which is an equivalence, so the first of each key stands for all."""
    rows = edges.where("type <> 'same_as'").withColumn("_ext", externals(F.col("identifiers")))
    plain = rows.where(F.size("_ext") == 0).select("ordinal", "src", "dst", "type", edge_identity(F.col("type"), F.col("properties")).alias("_key"))
    first = plain.groupBy("src", "dst", "type", "_key").agg(F.min("ordinal").alias("a"))
    stars = plain.join(first, ["src", "dst", "type", "_key"]).select("a", F.col("ordinal").alias("b"))
    each = rows.select("ordinal", "src", "dst", "type", F.explode("_ext").alias("i")).withColumn("_value", X.trimmed(F.col("i.value"))).withColumn("_scheme", F.col("i.scheme"))
    keys = ["src", "dst", "type", "_scheme", "_value"]
    other = each.select(*keys, F.col("ordinal").alias("b"), F.col("i").alias("j"))
    pairs = each.withColumnRenamed("ordinal", "a").join(other, keys).where("a < b").where(X.identifiers_match(F.col("i"), F.col("j"))).select("a", "b")
    return stars.where("a <> b").unionByName(pairs).distinct()


def merge_edges(g: SupplyGraph, grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merged edges between merged nodes; those whose ends don't resolve are left out."""
    place = g.nodes.groupBy("file_idx", "id").agg(F.min("ordinal").alias("ordinal")).join(grouped, "ordinal").select("file_idx", "id", "rep")
    edges = g.edges
    for end, name in (("source", "src"), ("target", "dst")):
        edges = edges.join(place.select("file_idx", F.col("id").alias(end), F.col("rep").alias(name)), ["file_idx", end])
    edges = written(edges.select("ordinal", "src", "dst", "type", "identifiers", "properties", "extra"), "edges")
    part = components(edge_links(edges)).select(F.col("node").alias("ordinal"), "component")
    edges = edges.join(part, "ordinal", "left").withColumn("rep", F.coalesce("component", "ordinal")).drop("component")
    lone = F.col("type") == "same_as"
    base = edges.groupBy("rep").agg(F.min_by(F.struct("src", "dst", "type", "properties", F.when(lone, F.col("extra")).alias("extra")), "ordinal").alias("_f")).select("rep", "_f.*")
    low = edges.select("rep", F.explode(externals(F.col("identifiers"))).alias("i")).groupBy("rep").agg(F.min(X.canonical(F.col("i"))).alias("_eid"))
    labels = merged_labels(edges.select("rep", F.col("properties.labels").alias("labels")))
    out = base.join(low, "rep", "left").join(merged_identifiers(edges), "rep", "left").join(labels, "rep", "left")
    names = nodes.select("rep", "id", "_canonical")
    for end, name in (("source", "src"), ("target", "dst")):
        out = out.join(names.select(F.col("rep").alias(name), F.col("id").alias(end), F.col("_canonical").alias("_" + name)), name)
    lone = F.col("type") == "same_as"
    props = F.col("properties").withField("labels", F.when(lone, F.col("properties.labels")).otherwise(F.col("labels"))).withField("extra", F.when(lone, F.col("properties.extra")))
    out = out.withColumn("properties", props).withColumn("_type", X.type_name(F.col("type"))).withColumn("_eid", F.coalesce("_eid", F.lit("")))
    out = numbered(out, ["_src", "_dst", "_type", "_eid", "rep"], "id", "e-")
    return S.conform(out.withColumn("ordinal", F.col("rep")).withColumn("file_idx", F.lit(0)), S.EDGE)


def merge(graphs: list[SupplyGraph], threshold: str = "definite", group_limit: int = 50, salt: str | None = None, timestamp: str | None = None, check: bool = True, rewrite_entity: bool = True, strategy: str = "union") -> Merged:
    """``rewrite_entity``: a single reporting entity is given its new id; without it
    the old one stays, which the check then finds to be no node."""
    if strategy != "union":
        raise NotImplementedError("only the union of snapshots is there")
    if len(graphs) < 2:
        raise ArgumentError("two snapshots are needed")
    g = concat(graphs)
    grouped = written(groups(g, threshold), "groups")
    nodes, conflicts = merge_nodes(g, grouped)
    nodes = written(nodes, "nodes")
    edges = merge_edges(g, grouped, nodes)
    size = grouped.groupBy(F.col("rep").alias("component")).agg(F.count("*").alias("size"))
    head = _header(g, grouped, nodes, salt, rewrite_entity)
    out = SupplyGraph(head, nodes.select(list(S.NODE)), written(edges, "edges"))
    if check:
        from tiergraph.operators.validate import is_valid

        if not is_valid(out):
            raise InvalidOutput("the merged snapshot breaks a rule of level 1")
    return Merged(out, size.where(F.col("size") > group_limit), conflicts, _metadata(g, out, timestamp))


def _header(g: SupplyGraph, grouped: DataFrame, nodes: DataFrame, salt: str | None, rewrite: bool) -> DataFrame:
    import secrets

    one = g.header.agg(F.min_by("version", "file_idx").alias("version"), F.max("snapshot_date").alias("snapshot_date"), F.collect_set("reporting_entity").alias("_e"), F.min(F.when(F.col("reporting_entity").isNotNull(), F.col("file_idx"))).alias("_file"))
    one = one.withColumn("_entity", F.when(F.size("_e") == 1, F.col("_e")[0]))
    if rewrite:
        place = g.nodes.groupBy("file_idx", "id").agg(F.min("ordinal").alias("ordinal")).join(grouped, "ordinal").join(nodes.select("rep", F.col("id").alias("_new")), "rep")
        one = one.join(place.select(F.col("file_idx").alias("_file"), F.col("id").alias("_entity"), "_new"), ["_file", "_entity"], "left").withColumn("_entity", F.col("_new"))
    one = one.withColumn("reporting_entity", F.col("_entity")).withColumn("file_salt", F.lit(salt or secrets.token_hex(32))).withColumn("file_idx", F.lit(0))
    return S.conform(one, S.HEADER)


def _metadata(g: SupplyGraph, out: SupplyGraph, timestamp: str | None) -> DataFrame:
    files = g.header.agg(F.array_sort(F.collect_list(F.concat(F.lit("file_"), F.col("file_idx").cast("string")))).alias("source_files"), F.array_sort(F.collect_set("reporting_entity")).alias("reporting_entities"))
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.crossJoin(out.nodes.agg(F.count("*").alias("nodes"))).crossJoin(out.edges.agg(F.count("*").alias("edges"))).withColumn("timestamp", now)
