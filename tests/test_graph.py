"""The graph operators on small graphs typed by hand."""

import io
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tiergraph import cli
from tiergraph.components import components
from tiergraph.functions import expr as X
from tiergraph.graph import ArgumentError, BuildError, InvalidOutput, NodeNotFound, build
from tiergraph.operators import diff as D
from tiergraph.operators import merge as M
from tiergraph.operators import redact as R
from tiergraph.operators import subgraph as G
from tiergraph.operators import traverse as T
from tiergraph.operators import validate as V
from tiergraph.operators.select import Selectors, parse, query
from tiergraph.sources import cbor, files, xlsx

SALT = "00112233445566778899aabbccddeeff" * 2


def value(nodes, edges=(), **head):
    nodes = [n if isinstance(n, dict) else {"id": n, "type": "organization"} for n in nodes]
    edges = [e if isinstance(e, dict) else {"id": f"e{k}", "type": e[2] if len(e) > 2 else "supplies", "source": e[0], "target": e[1], "properties": {}} for k, e in enumerate(edges)]
    return {"omts_version": "0.1.0", "snapshot_date": "2026-01-01", "file_salt": SALT, "nodes": nodes, "edges": edges} | head


@pytest.fixture
def make(spark):
    return lambda *a, **k: cli.graph_of(spark, value(*a, **k))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_traversal(make):
    g = make("abcdef", ["ab", "bc", "cd", "ae", "ea", "ab", "ff"])
    assert ids(T.reachable(g, "a")) == ["b", "c", "d", "e"]
    assert ids(T.reachable(g, "d", "backward")) == ["a", "b", "c", "e"]
    assert ids(T.reachable(g, "a", "both", max_depth=1)) == ["b", "e"]
    assert ids(T.reachable(g, "a", max_depth=0)) == []
    assert T.shortest_path(g, "e", "d") == ["e", "a", "b", "c", "d"]
    assert T.shortest_path(g, "a", "a") == ["a"] and T.shortest_path(g, "d", "a") is None
    assert [r.path for r in T.all_paths(g, "a", "c").collect()] == [["a", "b", "c"]] * 2  # two parallel edges
    assert T.all_paths(g, "a", "d", 2).count() == 0
    assert {(r.component, tuple(r.cycle)) for r in T.detect_cycles(g).collect()} == {("a", ("a", "e", "a")), ("f", ("f", "f"))}
    assert T.detect_cycles(make("ab", ["ab"])).count() == 0
    with pytest.raises(NodeNotFound):
        T.reachable(g, "z")


def test_build_and_parts(make):
    g = make("abcd", ["ab", "bc", "cd"], reporting_entity="a")
    assert build(g) is g
    with pytest.raises(BuildError, match="more than once"):
        build(make("aab"))
    with pytest.raises(BuildError, match="target"):
        build(make("a", ["az"]))
    out = G.ego(g, "b", 1)
    assert ids(out.nodes) == ["a", "b", "c"] and out.edges.count() == 2
    assert out.header.first().reporting_entity == "a"
    assert G.ego(g, "c", 1).header.first().reporting_entity is None
    assert ids(G.subgraph(g, ["d"], None, 1, "2026-02-02").nodes) == ["c", "d"]


def test_selectors(make):
    g = make([{"id": "a", "type": "organization", "name": "ÉCLAIR Works", "labels": [{"key": "k"}, {"key": "p", "value": "x=y"}], "identifiers": [{"scheme": "duns", "value": "1:2"}]}, "b"], ["ab"])
    one = lambda **k: ids(query(g, parse(**k)))
    assert one(name=["éclair"]) == ["a"] and one(label=["k"]) == ["a"] and one(label=["p=x=y"]) == ["a"]
    assert one(identifier=["duns:1:2"]) == ["a"] and one(identifier=["gln"]) == [] and one(edge_type=["supplies"]) == ["e0"]
    assert ids(query(g, Selectors())) == ["a", "b", "e0"]
    with pytest.raises(ArgumentError):
        parse()


def test_rules_find_each_fault(make):
    ident = lambda scheme, v, **k: {"scheme": scheme, "value": v, **k}
    org = lambda i, *idents, **k: {"id": i, "type": "organization", "identifiers": list(idents), **k}
    faults = {
        "L1-EID-05": [ident("lei", "5493006MHB84DD0ZWV19")],
        "L1-EID-06": [ident("duns", "12")],
        "L1-EID-07": [ident("gln", "4006381333932")],
        "L1-EID-08": [ident("duns", "123456789", valid_from="2026-02-30")],
        "L1-EID-09": [ident("duns", "123456789", valid_from="2026-02-01", valid_to="2025-01-01")],
        "L1-EID-11": [ident("duns", "123456789"), ident("duns", "123456789")],
        "L1-EID-03": [ident("nat-reg", "1")],
        "L1-EID-04": [ident("odd", "1")],
        "L1-EID-01": [ident("", "1")],
    }
    g = make([org(f"n{k}", *idents) for k, idents in enumerate(faults.values())])
    got = {(r.rule_id, r.location.split('"')[1]) for r in V.validate(g, (1,)).collect()}
    assert got == {(rule, f"n{k}") for k, rule in enumerate(faults)}
    good = make([org("n", ident("lei", "5493006MHB84DD0ZWV18"), ident("gln", "4006381333931"), ident("com.own", "x"))])
    assert V.is_valid(good)


def test_boundary_hash_vector(spark):
    row = spark.range(1).select(X.boundary_hash(F.array(F.lit("lei:5493006MHB84DD0ZWV18"), F.lit("duns:081466849")), F.lit(SALT)).alias("h")).first()
    assert row.h == "e8798687b081da98b7cd1c4e5e2423bd3214fbab0f1f476a2dcdbf67c2e21141"


def party(names, **k):
    """Organizations by DUNS number; name and authority vary."""
    return value([{"id": f"{n}x", "type": "organization", "name": names[n], "identifiers": [{"scheme": "duns", "value": f"{n:09d}"}]} for n in names], **k)


def test_merge_is_commutative_and_idempotent(spark):
    r = random.Random(2)
    parties = [party({n: r.choice(("A", "B")) for n in r.sample(range(6), 4)}) for _ in range(3)]
    graphs = [cli.graph_of(spark, p) for p in parties]
    seen = lambda m: sorted((x.name or "", json.dumps([i.value for i in x.identifiers])) for x in m.graph.nodes.collect())
    first = seen(M.merge(graphs, check=False))
    assert all(seen(M.merge(list(p), check=False)) == first for p in list(itertools.permutations(graphs))[:3])
    once = M.merge([graphs[0], graphs[0]], check=True)
    assert seen(once) == sorted((n["name"], json.dumps([n["identifiers"][0]["value"]])) for n in parties[0]["nodes"])
    with pytest.raises(NotImplementedError):
        M.merge(graphs, strategy="intersect")


def test_merge_guards(make):
    lei = {"scheme": "lei", "value": "5493006MHB84DD0ZWV18"}
    one = lambda i, **k: {"id": i, "type": "organization", "identifiers": [{"scheme": "duns", "value": "000000001"} | k]}
    count = lambda *parts, **k: M.merge([make([p]) for p in parts], check=False, **k).graph.nodes.count()
    assert count(one("a"), one("b")) == 1
    assert count(one("a", valid_to="2020-01-01"), one("b", valid_from="2021-01-01")) == 2
    assert count(one("a", valid_from="2020-01-01"), one("b")) == 1
    gone = {"id": "a", "type": "organization", "identifiers": [lei | {"entity_status": "ANNULLED"}]}
    assert count(gone, gone | {"id": "b"}) == 2
    same = lambda c: {"id": "s", "type": "same_as", "source": "a", "target": "b", "properties": {"confidence": c}}
    pair = lambda c, **k: M.merge([make("ab", [same(c)]), make("c")], check=False, **k).graph.nodes.count()
    assert pair("definite") == 2 and pair("probable") == 3 and pair("probable", threshold="probable") == 2


def test_diff(make):
    a = make([{"id": "a", "type": "organization", "name": "N", "identifiers": [{"scheme": "duns", "value": "000000001"}]}, "b", "c"], ["ab"])
    b = make([{"id": "z", "type": "organization", "name": "M", "valid_from": "2020-1-5", "identifiers": [{"scheme": "duns", "value": "000000001"}]}, "b", "d"], [("z", "b")])
    assert D.diff(a, a).is_empty()
    d = D.diff(a, b)
    assert ids(d.nodes_added) == ["d"] and ids(d.nodes_removed) == ["c"]
    assert {(r.field, r.old_value, r.new_value) for r in d.node_changes.collect()} == {("name", "N", "M"), ("valid_from", None, "2020-1-5")}
    assert d.edges_matched.count() == 1 and not d.is_empty()
    same = lambda v: make([{"id": "a", "type": "organization", "valid_from": v}])
    assert D.diff(same("2020-1-5"), same("2020-01-05")).is_empty() and not D.diff(same("2020-01-06"), same("2020-01-05")).is_empty()
    open_ = make([{"id": "a", "type": "organization", "valid_to": None}])
    assert [r.field for r in D.diff(open_, make("a")).node_changes.collect()] == ["valid_to"]


def test_redact(make):
    person = {"id": "p", "type": "person", "identifiers": [{"scheme": "duns", "value": "000000003"}]}
    owner = {"id": "o", "type": "beneficial_ownership", "source": "p", "target": "a", "properties": {"percentage": 5.0}}
    sold = {"id": "s", "type": "supplies", "source": "a", "target": "b", "properties": {"contract_ref": "C", "volume_unit": "t"}}
    g = make(["a", "b", person], [owner, sold])
    keep = g.nodes.where("id = 'a'").select("id")
    out = R.redact(g, "public", keep, check=False)
    assert {(r.id, r.type) for r in out.nodes.collect()} == {("a", "organization"), ("b", "boundary_ref")}
    props = out.edges.first().properties
    assert out.edges.count() == 1 and props.contract_ref is None and props.volume_unit == "t"
    assert R.redact(g, "internal").nodes.count() == 3
    assert R.redact(g, "partner", check=False).edges.count() == 0  # all replaced
    with pytest.raises(InvalidOutput):
        R.redact(make("a", reporting_entity="a"), "public")
    with pytest.raises(ArgumentError):
        R.narrower("public", "partner")


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 6000 + k) for k in range(100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(x.node, x.component) for x in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_codecs_round_trip():
    v = value([{"id": "a", "type": "x.y", "own": {"k": [1, 2.5, None, "é"]}}], ["aa"], more=1)
    for target, packed in itertools.product(("json", "cbor"), (False, True)):
        assert files.decode(files.encode(v, target, packed)) == (v, target)
    with pytest.raises(files.ParseError, match="twice"):
        files.decode(files.compress(files.compress(b"{}")))
    with pytest.raises(files.ParseError):
        files.decode(b"\x00\x01")
    for bad in ("61", "82", "ff", "a101", "1f"):
        with pytest.raises(cbor.CborError):
            cbor.loads(bytes.fromhex(bad))


def test_files(spark, tmp_path):
    v = value([{"id": "a", "type": "organization", "valid_to": None, "geo": {"lat": 1.5, "lon": 2}, "labels": [{"key": "k"}], "own": [1]}, "b"], ["ab"], reporting_entity="a")
    for k, (target, packed) in enumerate((("json", False), ("cbor", True))):
        (tmp_path / f"{k}.omts").write_bytes(files.encode(v, target, packed))
    g = files.load(spark, str(tmp_path / "*.omts"))
    assert g.nodes.count() == 4 and g.nodes.select("ordinal").distinct().count() == 4
    one = files.load(spark, str(tmp_path / "1.omts"))
    assert files.to_value(one) == v
    files.save_parquet(one, str(tmp_path / "store"))
    assert files.to_value(files.load_parquet(spark, str(tmp_path / "store"))) == v
    (tmp_path / "bad.omts").write_bytes(b"{}")
    assert files.parse_problems(spark, str(tmp_path / "bad.omts")).count() == 1


def test_workbooks():
    sheet = [["Reporting Entity", "Acme", "Snapshot Date", "2026-01-01"], [], [], xlsx.LIST, ["Bolt", "B1", "DE", 1, None, "north"], ["Nut", None, "FR", 2, "Bolt"], ["Bolt", "B1", "DE", 9, "Nut"]]
    v = xlsx.load(xlsx.write({"Supplier List": sheet}), salt=SALT)
    assert files.shape_problem(v) is None
    assert [(e["source"], e["target"], e["properties"]["tier"]) for e in v["edges"]] == [("org-bolt", "org-acme", 1), ("org-nut", "org-bolt", 2), ("org-bolt", "org-nut", 3)]
    assert len(xlsx.load(xlsx.export_list(v))["nodes"]) == 3
    full = xlsx.load(xlsx.export_full(v))
    assert [n["id"] for n in full["nodes"]] == [n["id"] for n in v["nodes"]] and len(full["edges"]) == 3
    assert xlsx.letters(27) == "AB" and xlsx.column("AB") == 27
    with pytest.raises(files.ParseError):
        xlsx.load(b"no zip")


def test_cli(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_bytes(files.encode(value([{"id": "a", "type": "organization", "name": "A"}, "b"], ["ab"])))

    def run(*argv):
        out = io.StringIO()
        return cli.run([str(x) for x in argv], spark, out), out.getvalue()

    assert run("validate", path, "--level", 1) == (0, "")
    assert run("query", path, "--name", "a")[1].split() == ["node", "a", "organization", "A"]
    assert run("query", path, "--name", "zz")[0] == 1 and run("query", path)[0] == 2
    assert run("reach", path, "a") == (0, "b\n") and run("reach", path, "zz")[0] == 1
    assert run("path", path, "b", "a")[0] == 1
    assert run("diff", path, path)[0] == 0
    assert json.loads(run("convert", path, "--pretty")[1])["nodes"][1]["id"] == "b"
    assert run("validate", tmp_path / "none")[0] == 2 and run("nonsense")[0] == 2
    assert run("init", "--example")[0] == 0


def test_the_first_repeated_id_is_named(make):
    with pytest.raises(BuildError, match="'b'"):
        build(make("abba"))


def test_diff_matches_edges_by_their_identifiers(make):
    ident = lambda v, **k: [{"scheme": "nat-reg", "value": v, **k}]
    edge = lambda i, idents=None: {"id": i, "type": "supplies", "source": "a", "target": "b", "properties": {}} | ({"identifiers": idents} if idents else {})
    met = lambda x, y: D.diff(make("ab", x), make("ab", y)).edges_matched.count()
    assert met([edge("x", ident("7", authority="DE"))], [edge("y", ident(" 7 ", authority="de"))]) == 1
    assert met([edge("x", ident("7", authority="DE"))], [edge("y", ident("7"))]) == 0
    assert met([edge("x", ident("7", authority="DE", valid_to="2020-01-01"))], [edge("y", ident("7", authority="DE", valid_from="2021-01-01"))]) == 0
    assert met([edge("x", ident("7", authority="DE"))], [edge("y")]) == 0
    many = [edge(f"x{k}", ident("7", authority="DE")) for k in range(3)]
    assert met(many + [edge("p"), edge("q")], many[:2] + [edge("p")]) == 3


def test_redaction_keeps_types_and_draws_tokens_once(make):
    from tiergraph.operators import redact as R

    keep = {"_property_sensitivity": {"percentage": "confidential"}, "n": 5, "on": True, "o": {"k": [1, "x"]}, "s": "5"}
    g = make([{"id": "a", "type": "organization"}, {"id": "b", "type": "organization"}, {"id": "p", "type": "person"}], [{"id": "e", "type": "ownership", "source": "a", "target": "b", "properties": {"percentage": 5.0, **keep}}])
    out = R.redact(g, "public", g.nodes.where("id = 'a'").select("id"))
    assert json.loads(out.edges.first().properties.extra) == {k: v for k, v in keep.items() if k[0] != "_"}
    token = lambda: out.nodes.where("id = 'b'").first().identifiers[0].value
    assert ids(out.nodes) == ["a", "b"] and re.fullmatch("[0-9a-f]{64}", token()) and token() == token()
    assert token() != R.redact(g, "public", g.nodes.where("id = 'a'").select("id")).nodes.where("id = 'b'").first().identifiers[0].value


def test_large_files_are_refused_unread(spark, tmp_path):
    from tiergraph.sources import files

    (tmp_path / "a.json").write_bytes(b"{" * 500)
    with pytest.raises(files.ParseError, match="more than 100 bytes"):
        files.load(spark, str(tmp_path), max_bytes=100)


def test_diff_for_people(make):
    from tiergraph.operators.diff import to_lines

    a = make([{"id": "a", "type": "organization", "name": "N", "identifiers": [{"scheme": "duns", "value": "000000001"}]}, "b", "c"], ["ab"])
    b = make([{"id": "z", "type": "organization", "name": "M", "labels": [{"key": "k", "value": "v"}], "identifiers": [{"scheme": "duns", "value": "000000001"}]}, "b", "d"], [("z", "b"), ("b", "d")])
    lines = [r.line for r in to_lines(D.diff(a, b)).collect()]
    assert lines == ["+ edge e1 (supplies)", "+ node d (organization)", "- node c (organization)", "~ node a = z: + label k=v", "~ node a = z: name: N -> M"]


def test_register_lookup(spark, make):
    idents = make([{"id": "a", "type": "organization", "identifiers": [{"scheme": "nat-reg", "authority": "RA1", "value": "7"}, {"scheme": "nat-reg", "authority": "RA2", "value": "7"}]}]).identifiers().select("id", "ident.*")
    known = V.External(natreg=spark.createDataFrame([("RA1", "7", "ACTIVE")], "authority string, value string, status string"))
    assert [(r.id, r.authority, r.status) for r in known.registered(idents).collect()] == [("a", "RA1", "ACTIVE")]
    assert V.External().registered(idents).count() == 0
