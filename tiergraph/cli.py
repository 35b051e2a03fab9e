"""Commands over snapshot files. Exit codes: 0, 1 for a logical outcome, 2 for unusable input."""

from __future__ import annotations

import argparse
import datetime
import json
import secrets
import sys

from pyspark.sql import SparkSession

from tiergraph.graph import ArgumentError, GraphError, NoResults, SupplyGraph, build
from tiergraph.sources import files, xlsx


def _read(path: str, limit: int) -> bytes:
    data = sys.stdin.buffer.read(limit + 1) if path == "-" else open(path, "rb").read(limit + 1)  # noqa: SIM115
    if len(data) > limit:
        raise files.ParseError(f"{path}: more than {limit} bytes")
    return data


def graph_of(spark: SparkSession, value: dict) -> SupplyGraph:
    from pyspark.sql import functions as F

    from tiergraph import schema as S

    head, nodes, edges = files.tables(value)
    rows = [("header", json.dumps(head | {"file_idx": 0}))]
    rows += [(kind, json.dumps(x | {"file_idx": 0, "ordinal": k})) for kind, part in (("node", nodes), ("edge", edges)) for k, x in enumerate(part)]
    df = spark.createDataFrame(rows, "kind string, row string")
    part = lambda kind, fields: df.where(F.col("kind") == kind).select(F.from_json("row", files._ddl(fields)).alias("r")).select("r.*")
    return SupplyGraph(part("header", S.HEADER), part("node", S.NODE), part("edge", S.EDGE))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tiergraph")
    p.add_argument("-f", "--format", choices=("human", "json"), default="human")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--max-file-size", type=int, default=files.MAX_BYTES)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, many: bool = False, out: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if name != "init":
            c.add_argument("file", nargs="+" if many else None)
        if out:
            c.add_argument("-o", "--output", default="-")
            c.add_argument("--to", choices=("json", "cbor"), default="json")
            c.add_argument("--compress", action="store_true")
            c.add_argument("--pretty", action="store_true")
        return c

    def selectors(c: argparse.ArgumentParser) -> None:
        for name in ("node-type", "edge-type", "label", "identifier", "jurisdiction", "name"):
            c.add_argument(f"--{name}", action="append", default=[])

    command("validate").add_argument("--level", type=int, choices=(1, 2, 3), default=2)
    c = command("merge", many=True, out=True)
    c.add_argument("--strategy", choices=("union", "intersect"), default="union")
    c.add_argument("--same-as", choices=("definite", "probable", "possible"), default="definite")
    command("redact", out=True).add_argument("--scope", required=True)
    c = command("diff")
    c.add_argument("other")
    for name in ("node-type", "edge-type", "ignore"):
        c.add_argument(f"--{name}", action="append")
    command("inspect")
    command("convert", out=True)
    c = command("query")
    selectors(c)
    c.add_argument("--count", action="store_true")
    for name in ("reach", "path"):
        c = command(name)
        c.add_argument("start")
        if name == "path":
            c.add_argument("end")
            c.add_argument("--max-paths", type=int, default=10)
            c.add_argument("--max-depth", type=int, default=20)
        else:
            c.add_argument("--depth", type=int)
            c.add_argument("--direction", choices=("outgoing", "incoming", "both"), default="outgoing")
    c = command("subgraph", out=True)
    c.add_argument("ids", nargs="*")
    c.add_argument("--expand", type=int, default=0)
    selectors(c)
    command("import", out=True).add_argument("--authority", default="supplier-list")
    c = command("export")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--list", action="store_true")
    command("init", out=True).add_argument("--example", action="store_true")
    return p


def run(argv: list[str], spark: SparkSession, out=sys.stdout) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return _run(a, spark, out)
    except NotImplementedError as e:
        print(e, file=sys.stderr)
        return 2
    except GraphError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(e, file=sys.stderr)
        return 2


def _run(a, spark: SparkSession, out) -> int:
    from tiergraph.operators import diff as D
    from tiergraph.operators import inspect as I
    from tiergraph.operators import merge as M
    from tiergraph.operators import redact as R
    from tiergraph.operators import subgraph as G
    from tiergraph.operators import traverse as T
    from tiergraph.operators import validate as V
    from tiergraph.operators.select import counts, parse, query

    today = datetime.date.today().isoformat()

    def show(df) -> int:
        rows = [r.asDict(recursive=True) for r in df.collect()]
        for r in rows if not a.quiet else []:
            print(json.dumps(r) if a.format == "json" else "\t".join("" if v is None else str(v) for v in r.values()), file=out)
        return len(rows)

    def save(value: dict) -> int:
        data = files.encode(value, a.to, a.compress, a.pretty)
        if a.output != "-":
            with open(a.output, "wb") as f:
                f.write(data)
        else:
            out.write(data.decode() if a.to == "json" and not a.compress else data.hex())
        return 0

    if a.command == "init":
        return save(files.initial(today, secrets.token_hex(32), a.example))
    if a.command == "import":
        data = xlsx.read(_read(a.file, a.max_file_size))
        value = xlsx.import_list(data, a.authority) if "Supplier List" in data else xlsx.import_full(data)
        problem = files.shape_problem(value)
        if problem:
            raise files.ParseError(problem)
        if not V.is_valid(graph_of(spark, value)):
            raise files.ParseError("the imported snapshot breaks a rule of level 1")
        return save(value)
    values = [files.decode(_read(f, a.max_file_size), a.max_file_size)[0] for f in (a.file if isinstance(a.file, list) else [a.file])]
    if a.command == "convert":
        return save(values[0])
    if a.command == "export":
        with open(a.output, "wb") as f:
            f.write(xlsx.export_list(values[0]) if a.list else xlsx.export_full(values[0]))
        return 0
    graphs = [graph_of(spark, v) for v in values]
    g = graphs[0]
    if a.command == "validate":
        found = V.validate(g, tuple(range(1, a.level + 1)), ordered=True)
        show(found)
        return int(bool(found.where("severity = 'error'").limit(1).count()))
    if a.command == "inspect":
        for df in (I.totals(g).select("version", "snapshot_date", "disclosure_scope", "nodes", "edges"), I.node_counts(g), I.edge_counts(g), I.identifier_counts(g)):
            show(df)
        return 0
    if a.command == "merge":
        if not all(V.is_valid(x) for x in graphs):
            raise files.ParseError("a snapshot breaks a rule of level 1")
        return save(files.to_value(M.merge(graphs, a.same_as, strategy=a.strategy).graph))
    if a.command == "redact":
        R.narrower(values[0].get("disclosure_scope"), a.scope)
        return save(files.to_value(R.redact(g, a.scope)))
    if a.command == "diff":
        other = graph_of(spark, files.decode(_read(a.other, a.max_file_size), a.max_file_size)[0])
        d = D.diff(g, other, D.Filter(a.node_type, a.edge_type, a.ignore or []))
        show(d.warnings)
        show(D.to_json(d) if a.format == "json" else D.to_lines(d))
        return int(not d.is_empty())
    if a.command in ("query", "subgraph"):
        words = (a.node_type, a.edge_type, a.label, a.identifier, a.jurisdiction, a.name)
        chosen = parse(*words) if a.command == "query" or any(words) else None
    if a.command == "query":
        if not show(counts(g, chosen) if a.count else query(g, chosen)):
            raise NoResults("no node or edge matches")
        return 0
    build(g)
    if a.command == "subgraph":
        return save(files.to_value(G.subgraph(g, a.ids, chosen, a.expand, today)))
    if a.command == "reach":
        show(T.reachable(g, a.start, T.DIRECTIONS[a.direction], None, a.depth).orderBy("id").select("id"))
        return 0
    if a.command == "path":
        show(T.paths(g, a.start, a.end, a.max_paths, a.max_depth, strict=True))
        return 0
    raise ArgumentError(f"no command: {a.command}")


def main() -> None:
    spark = SparkSession.builder.appName("tiergraph").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sys.exit(run(sys.argv[1:], spark))


if __name__ == "__main__":
    main()
