"""Workbooks: cells of .xlsx files with the standard library alone, and snapshots in them.

A workbook is made by hand and read on the driver; what comes out is a snapshot
value as of a JSON file.
"""

from __future__ import annotations

import io
import re
import secrets
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from tiergraph import schema as S
from tiergraph.sources.files import ParseError

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
Sheets = dict[str, list[list]]


def column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def read(data: bytes) -> Sheets:
    """The cells of each sheet, row by row; missing ones are None."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"not a workbook: {e}") from e
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    out: Sheets = {}
    for sheet in book.iter(f"{_NS}sheet"):
        path = links[sheet.get(_REL)].lstrip("/")
        rows: list[list] = []
        for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{_NS}row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [[] for _ in range(at + 1 - len(rows))]
            for i, c in enumerate(row.iter(f"{_NS}c")):
                k = column(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else i
                rows[at] += [None] * (k + 1 - len(rows[at]))
                rows[at][k] = _cell(c, shared)
        out[sheet.get("name")] = rows
    return out


def _cell(c, shared: list[str]):
    v, kind = c.find(f"{_NS}v"), c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return v.text
    x = float(v.text)
    return int(x) if x.is_integer() else x


def write(sheets: Sheets) -> bytes:
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _NS[1:-1], _REL[1:-3]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_written(f"{letters(k)}{r}", v) for k, v in enumerate(row) if v is not None and v != "") + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _written(ref: str, v) -> str:
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def text(v) -> str | None:
    if v is None:
        return None
    out = ("true" if v else "false") if isinstance(v, bool) else str(v).strip()
    return out or None


def records(rows: list[list], header: int = 0) -> list[dict]:
    """A dict for each row below the header; empty cells and empty rows are left out."""
    if len(rows) <= header:
        return []
    names = [(text(c) or "").lower() for c in rows[header]]
    out = []
    for row in rows[header + 1 :]:
        got = {n: v for n, v in zip(names, row, strict=False) if n and text(v) is not None}
        if got:
            out.append(got)
    return out


def slug(prefix: str, name: str | None, counter: int) -> str:
    body = re.sub("[^a-z0-9]+", "-", (name or "").lower() if (name or "").isascii() else "".join(c.lower() if c.isascii() else "-" for c in name or "")).strip("-")
    return f"{prefix}-{body[:48].rstrip('-')}" if body else f"{prefix}-{counter}"


def _number(r: dict, name: str):
    if name not in r:
        return None
    try:
        return float(r[name])
    except ValueError as e:
        raise ParseError(f"{name}: not a number: {r[name]}") from e


def _put(out: dict, r: dict, *names: str, number: bool = False) -> dict:
    for n in names:
        v = _number(r, n) if number else text(r.get(n))
        if v is not None:
            out[n] = v
    return out


# Sheets of nodes with their type, prefix of ids, and columns of text and number.
NODE_SHEETS = {
    "Organizations": ("organization", "org", ("name", "jurisdiction", "status"), ()),
    "Facilities": ("facility", "fac", ("name", "address"), ()),
    "Goods": ("good", "good", ("name", "commodity_code", "unit"), ()),
    "Persons": ("person", "person", ("name", "jurisdiction", "role"), ()),
    "Attestations": ("attestation", "att", ("name", "attestation_type", "standard", "issuer", "valid_from", "valid_to", "outcome", "reference", "risk_severity", "risk_likelihood"), ()),
    "Consignments": ("consignment", "con", ("name", "lot_id", "unit", "production_date", "origin_country", "emission_factor_source", "installation_id"), ("quantity", "direct_emissions_co2e", "indirect_emissions_co2e")),
}
INLINE = (("lei", "lei", None), ("duns", "duns", None), ("nat-reg", "nat_reg_value", "nat_reg_authority"), ("vat", "vat_value", "vat_country"), ("internal", "internal_id", "internal_system"))


def _identifiers(r: dict) -> list[dict]:
    out = []
    for scheme, value, authority in INLINE:
        if text(r.get(value)):
            out.append({"scheme": scheme, "value": text(r[value])} | ({"authority": text(r[authority])} if authority and text(r.get(authority)) else {}))
    return out


def import_full(sheets: Sheets, salt: str | None = None) -> dict:
    """A snapshot value from a workbook of node, edge and identifier sheets."""
    if "Organizations" not in sheets:
        raise ParseError("the workbook has no sheet Organizations")
    meta = {(text(r[0]) or "").lower(): text(r[1]) for r in sheets.get("Metadata", []) if len(r) > 1 and r[0] is not None}
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", meta.get("snapshot_date") or ""):
        raise ParseError("Metadata: snapshot_date is missing or no date")
    quality = {k: meta[f"default_{k}"] for k in ("confidence", "source") if meta.get(f"default_{k}")}
    nodes, counter, edges = [], 0, []
    for sheet, (kind, prefix, names, numbers) in NODE_SHEETS.items():
        for r in records(sheets.get(sheet, [])):
            counter += 1
            n = _put({"id": text(r.get("id")) or slug(prefix, text(r.get("name")), counter), "type": kind}, r, *names)
            _put(n, r, *numbers, number=True)
            if kind == "organization" and (found := _identifiers(r)):
                n["identifiers"] = found
            if kind == "person" and "jurisdiction" not in n:
                _put(n, {"jurisdiction": r.get("nationality")}, "jurisdiction")
            if kind == "facility":
                _put(n, {"operator": r.get("operator_id", r.get("operator"))}, "operator")
                if "latitude" in r and "longitude" in r:
                    n["geo"] = {"lat": _number(r, "latitude"), "lon": _number(r, "longitude")}
            if kind == "attestation":
                _put(n, {"attestation_status": r.get("status")}, "attestation_status")
                if text(r.get("attested_entity_id")):
                    edges.append((r, "attested_by", text(r["attested_entity_id"]), n["id"], _put({}, r, "scope")))
            if quality:
                n["data_quality"] = dict(quality)
            nodes.append(n)
    by_id = {n["id"]: n for n in nodes}
    for r in records(sheets.get("Identifiers", [])):
        n = by_id.get(text(r.get("node_id")))
        if n is None:
            raise ParseError(f"Identifiers: there is no node {r.get('node_id')}")
        n.setdefault("identifiers", []).append(_put({}, r, "scheme", "value", "authority", "sensitivity", "valid_from", "valid_to", "verification_status", "verification_date"))
    for n in nodes:
        if "identifiers" in n:  # the first of each scheme and value stays
            n["identifiers"] = list({(i.get("scheme"), i.get("value")): i for i in reversed(n["identifiers"])}.values())[::-1]
            if n["type"] == "person":
                for i in n["identifiers"]:
                    i.setdefault("sensitivity", "confidential")
    for sheet, default, ends, names, numbers in (
        ("Supply Relationships", "supplies", ("supplier_id", "buyer_id"), ("valid_from", "valid_to", "commodity", "volume_unit", "value_currency", "contract_ref"), ("tier", "volume", "annual_value", "share_of_buyer_demand")),
        ("Corporate Structure", "ownership", ("subsidiary_id", "parent_id"), ("valid_from", "valid_to", "consolidation_basis", "control_type", "event_type", "effective_date", "description"), ("percentage",)),
    ):
        for r in records(sheets.get(sheet, [])):
            kind = text(r.get("type"))
            props = _put(_put({}, r, *names), r, *numbers, number=True)
            if "tier" in props:
                props["tier"] = int(props["tier"])
            if "direct" in r:
                props["direct"] = text(r["direct"]).lower() in ("true", "yes", "1")
            edges.append((r, kind if kind in S.EDGE_TYPES else default, text(r.get(ends[0])), text(r.get(ends[1])), props))
    for r in records(sheets.get("Same As", [])):
        edges.append((r, "same_as", text(r.get("entity_a")), text(r.get("entity_b")), _put({}, r, "basis", "confidence")))
    out = []
    for k, (r, kind, source, target, props) in enumerate(edges, 1):
        for end in (source, target):
            if end not in by_id:
                raise ParseError(f"{kind}: there is no node {end}")
        out.append({"id": (text(r.get("id")) if kind != "attested_by" else None) or f"e-{kind}-{source}-{target}-{k}", "type": kind, "source": source, "target": target, "properties": props})
    if meta.get("disclosure_scope") == "public" and any(n["type"] == "person" for n in nodes):
        raise ParseError("a public snapshot can't hold persons")
    head = {"omts_version": "1.0.0", "snapshot_date": meta["snapshot_date"], "file_salt": salt or secrets.token_hex(32)}
    head |= {k: meta[k] for k in ("disclosure_scope", "reporting_entity") if meta.get(k)}
    return head | {"nodes": nodes, "edges": out}


# The columns of a supplier list, from its fourth row on.
LIST = ["supplier_name", "supplier_id", "jurisdiction", "tier", "parent_supplier", "business_unit", "commodity", "valid_from", "annual_value", "value_currency", "contract_ref", "lei", "duns", "vat", "vat_country", "internal_id", "risk_tier", "kraljic_quadrant", "approval_status", "notes"]
LIST_LABELS = {"risk_tier": "risk-tier", "kraljic_quadrant": "kraljic-quadrant", "approval_status": "approval-status", "business_unit": "business-unit"}


def import_list(sheets: Sheets, authority: str = "supplier-list", salt: str | None = None) -> dict:
    """A snapshot value from a list of suppliers of one reporting entity.

    Suppliers are told apart by id, else by name, and the first row of each gives
    its fields; a supplier of tier 2 or 3 supplies its parent."""
    rows = sheets["Supplier List"]
    at = lambda r, c: text(rows[r][c]) if len(rows) > r and len(rows[r]) > c else None
    if not at(0, 1):
        raise ParseError("Supplier List!B1: the reporting entity is missing")
    entity = {"id": slug("org", at(0, 1), 0), "type": "organization", "name": at(0, 1)}
    listed = [r for r in records(rows, 3) if text(r.get("supplier_name"))]
    if not listed:
        raise ParseError("Supplier List!A5: there is no supplier")
    key = lambda r: ("id", text(r["supplier_id"])) if text(r.get("supplier_id")) else ("name", text(r["supplier_name"]))
    nodes, ids, names = {}, {}, {}
    for k, r in enumerate(listed, 1):
        if key(r) in nodes:
            continue
        own = slug("org", text(r["supplier_name"]), k)
        while own == entity["id"] or own in ids:
            own += "-supplier" if own == entity["id"] else f"-{k}"
        n = _put({"id": own, "type": "organization", "name": text(r["supplier_name"])}, r, "jurisdiction")
        found = [{"scheme": s, "value": text(r[s])} | ({"authority": text(r["vat_country"])} if s == "vat" and text(r.get("vat_country")) else {}) for s in ("lei", "duns", "vat") if text(r.get(s))]
        if text(r.get("supplier_id")):
            found.append({"scheme": "internal", "value": text(r["supplier_id"]), "authority": authority})
        if found:
            n["identifiers"] = found
        nodes[key(r)], ids[own] = n, n
        names.setdefault(n["name"], own)
        if text(r.get("supplier_id")):
            names.setdefault(text(r["supplier_id"]), own)
    edges = []
    for k, r in enumerate(listed, 1):
        tier = min(3, max(1, int(_number(r, "tier") or 1)))
        target = entity["id"] if tier == 1 else names.get(text(r.get("parent_supplier")))
        if target is None:
            raise ParseError(f"Supplier List!E{k + 4}: a supplier of tier {tier} needs a parent that is in the list")
        props = _put({"tier": tier}, r, "commodity", "valid_from", "value_currency", "contract_ref")
        _put(props, r, "annual_value", number=True)
        labels = [{"key": name, "value": text(r[c])} for c, name in LIST_LABELS.items() if text(r.get(c))]
        if labels:
            props["labels"] = labels
        source = nodes[key(r)]["id"]
        edges.append({"id": f"e-supplies-{source}-{target}-{k}", "type": "supplies", "source": source, "target": target, "properties": props})
    date = at(0, 3) or "2000-01-01"
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ParseError("Supplier List!D1: no date")
    head = {"omts_version": "1.0.0", "snapshot_date": date, "file_salt": salt or secrets.token_hex(32), "reporting_entity": entity["id"]}
    if at(1, 1):
        if at(1, 1).lower() not in S.SCOPES:
            raise ParseError("Supplier List!B2: no scope")
        head["disclosure_scope"] = at(1, 1).lower()
    return head | {"nodes": [entity, *nodes.values()], "edges": edges}


def load(data: bytes, **options) -> dict:
    """A list of suppliers if there is one, else a full workbook."""
    sheets = read(data)
    return import_list(sheets, **options) if "Supplier List" in sheets else import_full(sheets)


def export_full(value: dict) -> bytes:
    """Sheets for a snapshot value; boundary references and extensions are left out."""
    head = [["field", "value"], ["snapshot_date", value["snapshot_date"]], ["reporting_entity", value.get("reporting_entity")], ["disclosure_scope", value.get("disclosure_scope")]]
    out: Sheets = {"README": [["Snapshot of a supply network; ids link the sheets."]], "Metadata": head}
    for sheet, (kind, _, names, numbers) in NODE_SHEETS.items():
        more = {"organization": [c for _, v, a in INLINE for c in (v, a) if c], "facility": ["operator_id", "latitude", "longitude"], "attestation": ["status", "attested_entity_id", "scope"]}.get(kind, [])
        columns = ["id", *names, *numbers, *more]
        rows = [columns]
        attested = {e["target"]: e for e in value["edges"] if e["type"] == "attested_by"}
        for n in value["nodes"]:
            if n["type"] == kind:
                r = dict(n)
                if kind == "organization":
                    for scheme, v, a in INLINE:
                        for i in n.get("identifiers") or []:
                            if i["scheme"] == scheme and v not in r:
                                r[v] = i["value"]
                                if a:
                                    r[a] = i.get("authority")
                geo = n.get("geo") if isinstance(n.get("geo"), dict) else {}
                r |= {"operator_id": n.get("operator"), "latitude": geo.get("lat"), "longitude": geo.get("lon")}
                if kind == "attestation":
                    e = attested.get(n["id"], {})
                    r |= {"status": n.get("attestation_status"), "attested_entity_id": e.get("source"), "scope": (e.get("properties") or {}).get("scope")}
                rows.append([r.get(c) for c in columns])
        out[sheet] = rows
    inline = {s for s, _, _ in INLINE}
    columns = ["node_id", "scheme", "value", "authority", "sensitivity", "valid_from", "valid_to", "verification_status", "verification_date"]
    out["Identifiers"] = [columns] + [[n["id"], *[i.get(c) for c in columns[1:]]] for n in value["nodes"] if n["type"] in S.NODE_TYPES and n["type"] != "boundary_ref" for i in n.get("identifiers") or [] if not (n["type"] == "organization" and i["scheme"] in inline)]
    supply = ("supplies", "subcontracts", "tolls", "distributes", "brokers", "sells_to", "operates", "produces", "composed_of")
    corporate = ("ownership", "operational_control", "legal_parentage", "former_identity", "beneficial_ownership")
    for sheet, kinds, ends, columns in (
        ("Supply Relationships", supply, ("supplier_id", "buyer_id"), ["valid_from", "valid_to", "commodity", "tier", "volume", "volume_unit", "annual_value", "value_currency", "contract_ref", "share_of_buyer_demand"]),
        ("Corporate Structure", corporate, ("subsidiary_id", "parent_id"), ["percentage", "direct", "valid_from", "valid_to", "consolidation_basis", "control_type", "event_type", "effective_date", "description"]),
        ("Same As", ("same_as",), ("entity_a", "entity_b"), ["basis", "confidence"]),
    ):
        out[sheet] = [["id", "type", *ends, *columns]] + [[e["id"], e["type"], e["source"], e["target"], *[(e.get("properties") or {}).get(c) for c in columns]] for e in value["edges"] if e["type"] in kinds]
    return write(out)


def export_list(value: dict) -> bytes:
    """One row for each supplier and supplies edge, by tier, name and business unit. The
    tier is the distance to the reporting entity, and 1 for those without a way to it."""
    orgs = {n["id"]: n for n in value["nodes"] if n["type"] == "organization"}
    supplies = [e for e in value["edges"] if e["type"] == "supplies"]
    entity, depth = value.get("reporting_entity"), {}
    level, k = {entity}, 0
    while level:
        k += 1
        level = {e["source"] for e in supplies if e["target"] in level} - depth.keys() - {entity}
        depth |= dict.fromkeys(level, k)
    rows = []
    for i, n in orgs.items():
        if i == entity:
            continue
        found = {s["scheme"]: s for s in reversed(n.get("identifiers") or [])}
        base = {"supplier_name": n.get("name") or "", "jurisdiction": n.get("jurisdiction"), "tier": depth.get(i, 1)}
        base |= {s: found[s]["value"] for s in ("lei", "duns", "vat") if s in found} | {"vat_country": found.get("vat", {}).get("authority"), "internal_id": i}
        base["supplier_id"] = next((s["value"] for s in n.get("identifiers") or [] if s["scheme"] == "internal" and s.get("authority") == "supplier-list"), None)
        for e in [e for e in supplies if e["source"] == i] or [{}]:
            p = e.get("properties") or {}
            labels = {x["key"]: x.get("value") for x in p.get("labels") or []}
            parent = orgs.get(e.get("target"), {}).get("name") if depth.get(i, 1) > 1 else None
            rows.append(base | {c: p.get(c) for c in ("commodity", "valid_from", "annual_value", "value_currency", "contract_ref")} | {c: labels.get(name) for c, name in LIST_LABELS.items()} | {"parent_supplier": parent})
    rows.sort(key=lambda r: (r["tier"], r["supplier_name"], r.get("business_unit") or ""))
    top = [["Reporting Entity", orgs.get(entity, {}).get("name"), "Snapshot Date", value["snapshot_date"]], ["Disclosure Scope", value.get("disclosure_scope")], [], LIST]
    return write({"Supplier List": top + [[r.get(c) for c in LIST] for r in rows]})
