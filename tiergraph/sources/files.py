"""Snapshots from and to files: JSON, CBOR, zstd around either, and Parquet.

Files are read as binary on the executors, brought to JSON text there, and taken
apart by Spark's JSON functions; one snapshot is one row until its nodes and edges
are exploded.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph import schema as S
from tiergraph.graph import ArgumentError, GraphError, SupplyGraph
from tiergraph.sources import cbor

MAX_BYTES = 256 << 20
MAX_RATIO = 4
ZSTD = b"\x28\xb5\x2f\xfd"


class ParseError(GraphError):
    exit_code = 2


def sniff(data: bytes) -> str:
    """json, cbor or zstd, by the first bytes."""
    if data[:4] == ZSTD:
        return "zstd"
    if data[:3] == cbor.SELF_DESCRIBED:
        return "cbor"
    if data.lstrip(b" \t\r\n")[:1] == b"{":
        return "json"
    raise ParseError(f"neither JSON nor CBOR nor zstd: {data[:4].hex()}")


def decompress(data: bytes, limit: int = MAX_BYTES * MAX_RATIO) -> bytes:
    import zstandard

    out, stream = bytearray(), zstandard.ZstdDecompressor().stream_reader(data)
    while part := stream.read(1 << 20):
        out += part
        if len(out) > limit:
            raise ParseError(f"more than {limit} bytes when decompressed")
    return bytes(out)


def compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def decode(data: bytes, max_bytes: int = MAX_BYTES) -> tuple[dict, str]:
    """The snapshot as a value, and the encoding inside any compression."""
    if len(data) > max_bytes:
        raise ParseError(f"more than {max_bytes} bytes")
    kind = sniff(data)
    if kind == "zstd":
        data = decompress(data, max_bytes * MAX_RATIO)
        if (kind := sniff(data)) == "zstd":
            raise ParseError("compressed twice")
    try:
        value = json.loads(data) if kind == "json" else cbor.jsonable(cbor.loads(data))
    except ValueError as e:
        raise ParseError(str(e)) from e
    problem = shape_problem(value)
    if problem:
        raise ParseError(problem)
    return value, kind


_SHAPES = {"omts_version": r"\d+\.\d+\.\d+", "snapshot_date": r"\d{4}-\d{2}-\d{2}", "file_salt": r"[0-9a-f]{64}"}
_CLOSED = {"sensitivity": S.SENSITIVITIES, "status": S.ENUMS["status"]}


def shape_problem(v) -> str | None:
    """What keeps a value from being a snapshot at all; rules judge the rest."""
    if not isinstance(v, dict):
        return "not an object"
    for name, shape in _SHAPES.items():
        if not isinstance(v.get(name), str) or not re.fullmatch(shape, v[name]):
            return f"{name}: missing or of the wrong shape"
    if v.get("disclosure_scope") not in (None, *S.SCOPES):
        return "disclosure_scope: unknown"
    for part, needs in (("nodes", ("id", "type")), ("edges", ("id", "type", "source", "target"))):
        if not isinstance(v.get(part), list):
            return f"{part}: missing"
        for i, x in enumerate(v[part]):
            if not isinstance(x, dict):
                return f"{part}[{i}]: not an object"
            for need in needs:
                if not isinstance(x.get(need), str) or not x[need]:
                    return f"{part}[{i}].{need}: missing or empty"
            if x.get("status") not in (None, *_CLOSED["status"]):
                return f"{part}[{i}].status: unknown"
            if x.get("jurisdiction") is not None and not re.fullmatch("[A-Z]{2}", str(x["jurisdiction"])):
                return f"{part}[{i}].jurisdiction: no country code"
            for j, ident in enumerate(x.get("identifiers") or []):
                if not isinstance(ident, dict) or not isinstance(ident.get("scheme"), str) or not isinstance(ident.get("value"), str):
                    return f"{part}[{i}].identifiers[{j}]: scheme or value missing"
                if ident.get("sensitivity") not in (None, *_CLOSED["sensitivity"]):
                    return f"{part}[{i}].identifiers[{j}].sensitivity: unknown"
    return None


def _text(v):
    """A value of open shape as JSON text with sorted keys."""
    return None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _rest(v: dict, known) -> str | None:
    left = {k: x for k, x in v.items() if k not in known}
    return _text(left) if left else None


def _struct(v, kind: str):
    """A value by the names of a struct type; what it has besides goes to ``extra``."""
    if v is None:
        return None
    names = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]  # flat, and no session is at hand on executors
    out = {n: v.get(n) for n in names}
    if "extra" in names:
        out["extra"] = _rest(v, names)
    if "valid_to_present" in names:
        out["valid_to_present"] = "valid_to" in v
    return out


def _fields(v: dict, fields: dict[str, str], known) -> dict:
    out = {}
    for name, kind in fields.items():
        x = v.get(name)
        if name == "extra":
            x = _rest(v, known)
        elif name == "valid_to_present":
            x = "valid_to" in v
        elif kind.startswith("array"):
            x = None if x is None else [_struct(y, kind[6:-1]) for y in x]
        elif kind.startswith("struct"):
            x = _properties(x or {}) if name == "properties" else _struct(x, kind)
        elif kind == "string" and x is not None and not isinstance(x, str):
            x = _text(x)
        elif kind == "double" and x is not None:
            x = float(x)
        out[name] = x
    return out


def _properties(v: dict) -> dict:
    return _fields(v, S.PROPERTY_FIELDS, S.PROPERTY_FIELDS)


def tables(value: dict) -> tuple[dict, list[dict], list[dict]]:
    names = {"version": "omts_version"}
    known = {names.get(k, k) for k in S.HEADER} | {"nodes", "edges"}
    head = {k: value.get(names.get(k, k)) for k in S.HEADER if k not in ("file_idx", "extra")} | {"extra": _rest(value, known)}
    nodes = [{"id": x["id"], "type": x["type"], **_fields(x, S.NODE_FIELDS, {"id", "type", *S.NODE_FIELDS})} for x in value["nodes"]]
    edges = [{"id": x["id"], "type": x["type"], **_fields(x, S.EDGE_FIELDS, {"id", "type", *S.EDGE_FIELDS})} for x in value["edges"]]
    return head, nodes, edges


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in fields.items())


def load(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_BYTES) -> SupplyGraph:
    """One graph of all files, numbered by their order of path; a file that can't be
    parsed stops the read. A snapshot of up to ``max_bytes`` is one row."""
    raw = spark.read.format("binaryFile").load(paths)
    # Names and lengths come from the listing: no content is read for them.
    listed = raw.select("path", "length").orderBy("path").collect()
    for r in listed:
        if r.length > max_bytes:
            raise ParseError(f"{r.path}: more than {max_bytes} bytes")
    order = {r.path: i for i, r in enumerate(listed)}

    def read(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                head, nodes, edges = tables(decode(bytes(content), max_bytes)[0])
                i = order[path]
                place = lambda k, i=i: {"file_idx": i, "ordinal": i << 40 | k}
                rows.append(("header", json.dumps(head | {"file_idx": i})))
                rows += [("node", json.dumps(x | place(k))) for k, x in enumerate(nodes)]
                rows += [("edge", json.dumps(x | place(k))) for k, x in enumerate(edges)]
            yield pd.DataFrame(rows, columns=["kind", "row"])

    from tiergraph.plans.shared import written

    rows = written(raw.select("path", "content").mapInPandas(read, "kind string, row string"), "snapshot")
    part = lambda kind, fields: rows.where(F.col("kind") == kind).select(F.from_json("row", _ddl(fields)).alias("r")).select("r.*")
    return SupplyGraph(part("header", S.HEADER), part("node", S.NODE), part("edge", S.EDGE))


def _plain(v, kind: str | None = None):
    """A row back as a JSON value, without what is null."""
    if isinstance(v, T.Row):
        v = v.asDict()
    if isinstance(v, dict):
        out = {}
        present = v.pop("valid_to_present", None)
        extra = v.pop("extra", None)
        for k, x in v.items():
            if x is not None:
                out[k] = _plain(x)
        if present and "valid_to" not in out:
            out["valid_to"] = None
        return out | (json.loads(extra) if extra else {})
    return [_plain(x) for x in v] if isinstance(v, list) else v


_OPEN = ("governance_structure", "geo", "control_type")


def _opened(v: dict) -> dict:
    for name in _OPEN:
        if isinstance(v.get(name), str):
            try:
                v[name] = json.loads(v[name])
            except ValueError:
                pass
    return v


def to_value(graph: SupplyGraph) -> dict:
    """The snapshot of one file as a value; it is brought to the driver, as one file must be."""
    head = graph.header.first().asDict()
    out = {"omts_version": head.pop("version")}
    head.pop("file_idx")
    out |= _plain(head)
    rows = lambda df: [_plain(r.asDict(recursive=True)) for r in df.orderBy("ordinal").drop("file_idx", "ordinal").collect()]
    out["nodes"] = [_opened(x) for x in rows(graph.nodes)]
    edges = rows(graph.edges)
    for e in edges:
        e["properties"] = _opened(e.get("properties") or {})
    return out | {"edges": edges}


def encode(value: dict, target: str = "json", compressed: bool = False, pretty: bool = False) -> bytes:
    if target not in ("json", "cbor"):
        raise ArgumentError(f"no target: {target!r}")
    data = cbor.dumps(value) if target == "cbor" else (json.dumps(value, indent=2 if pretty else None, separators=None if pretty else (",", ":"), ensure_ascii=False) + "\n").encode()
    return compress(data) if compressed else data


def save_parquet(graph: SupplyGraph, path: str) -> None:
    """The native layout: nodes and edges by type, so that a selection by type reads no others."""
    graph.header.write.mode("overwrite").parquet(f"{path}/header")
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_parquet(spark: SparkSession, path: str) -> SupplyGraph:
    fixed = lambda fields: T._parse_datatype_string(_ddl(fields))
    read = lambda name, fields: spark.read.schema(fixed(fields)).parquet(f"{path}/{name}")
    return SupplyGraph(read("header", S.HEADER), read("nodes", S.NODE).select(list(S.NODE)), read("edges", S.EDGE).select(list(S.EDGE)))


def initial(today: str, salt: str, example: bool = False) -> dict:
    """A snapshot to begin with: empty, or two organizations, a facility and two edges."""
    out = {"omts_version": "0.1.0", "snapshot_date": today, "file_salt": salt, "nodes": [], "edges": []}
    if example:
        out["nodes"] = [
            {"id": "org-buyer", "type": "organization", "name": "Buyer", "identifiers": [{"scheme": "duns", "value": "000000001"}]},
            {"id": "org-supplier", "type": "organization", "name": "Supplier", "identifiers": [{"scheme": "duns", "value": "000000002"}]},
            {"id": "fac-plant", "type": "facility", "name": "Plant", "operator": "org-supplier"},
        ]
        out["edges"] = [
            {"id": "e-supplies", "type": "supplies", "source": "org-supplier", "target": "org-buyer", "properties": {"tier": 1}},
            {"id": "e-operates", "type": "operates", "source": "org-supplier", "target": "fac-plant", "properties": {}},
        ]
        out["reporting_entity"] = "org-buyer"
    return out


def parse_problems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, problem) of the files that can't be parsed."""

    def read(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    decode(bytes(content))
                except ParseError as e:
                    rows.append((path, str(e)))
            yield pd.DataFrame(rows, columns=["path", "problem"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, "path string, problem string")
