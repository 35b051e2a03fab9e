"""Types of snapshots: nodes, edges, headers, and the fixed value sets of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = "struct<key:string,value:string>"
QUALITY = "struct<confidence:string,source:string,last_verified:string,extra:string>"
IDENTIFIER = (
    "struct<scheme:string,value:string,authority:string,valid_from:string,valid_to:string,valid_to_present:boolean,"
    "sensitivity:string,verification_status:string,verification_date:string,extra:string>"
)
#: Fields of a node after id and type. ``valid_to`` has three states: absent,
#: null (open-ended) and a date; ``valid_to_present`` tells the first two apart.
NODE_FIELDS = {
    "identifiers": f"array<{IDENTIFIER}>",
    "data_quality": QUALITY,
    "labels": f"array<{LABEL}>",
    "name": "string",
    "jurisdiction": "string",
    "status": "string",
    "governance_structure": "string",
    "operator": "string",
    "address": "string",
    "geo": "string",
    "commodity_code": "string",
    "unit": "string",
    "role": "string",
    "attestation_type": "string",
    "standard": "string",
    "issuer": "string",
    "valid_from": "string",
    "valid_to": "string",
    "valid_to_present": "boolean",
    "outcome": "string",
    "attestation_status": "string",
    "reference": "string",
    "risk_severity": "string",
    "risk_likelihood": "string",
    "lot_id": "string",
    "quantity": "double",
    "production_date": "string",
    "origin_country": "string",
    "direct_emissions_co2e": "double",
    "indirect_emissions_co2e": "double",
    "emission_factor_source": "string",
    "installation_id": "string",
    "extra": "string",
}
PROPERTY_FIELDS = {
    "data_quality": QUALITY,
    "labels": f"array<{LABEL}>",
    "valid_from": "string",
    "valid_to": "string",
    "valid_to_present": "boolean",
    "percentage": "double",
    "direct": "boolean",
    "control_type": "string",
    "consolidation_basis": "string",
    "event_type": "string",
    "effective_date": "string",
    "description": "string",
    "commodity": "string",
    "contract_ref": "string",
    "volume": "double",
    "volume_unit": "string",
    "annual_value": "double",
    "value_currency": "string",
    "tier": "bigint",
    "share_of_buyer_demand": "double",
    "service_type": "string",
    "quantity": "double",
    "unit": "string",
    "scope": "string",
    "extra": "string",
}
PROPERTIES = "struct<" + ",".join(f"{k}:{t}" for k, t in PROPERTY_FIELDS.items()) + ">"
EDGE_FIELDS = {"source": "string", "target": "string", "identifiers": f"array<{IDENTIFIER}>", "properties": PROPERTIES, "extra": "string"}
PLACE = {"file_idx": "int", "ordinal": "bigint"}
NODE = {**PLACE, "id": "string", "type": "string", **NODE_FIELDS}
EDGE = {**PLACE, "id": "string", "type": "string", **EDGE_FIELDS}
HEADER = {
    "file_idx": "int",
    "version": "string",
    "snapshot_date": "string",
    "file_salt": "string",
    "disclosure_scope": "string",
    "previous_snapshot_ref": "string",
    "snapshot_sequence": "bigint",
    "reporting_entity": "string",
    "extra": "string",
}
DIAGNOSTIC = "rule_id string, severity string, location string, message string"

# The names that snapshots may hold.
NODE_TYPES = ["organization", "facility", "good", "person", "attestation", "consignment", "boundary_ref"]
EDGE_TYPES = [
    "ownership", "operational_control", "legal_parentage", "former_identity", "beneficial_ownership", "supplies", "subcontracts", "tolls",
    "distributes", "brokers", "operates", "produces", "composed_of", "sells_to", "attested_by", "same_as",
]
CORE_SCHEMES = ["lei", "duns", "gln", "nat-reg", "vat", "internal", "opaque"]
WITH_AUTHORITY = ["nat-reg", "vat", "internal"]
SCOPES = ["internal", "partner", "public"]
SENSITIVITIES = ["public", "restricted", "confidential"]
ENUMS = {
    "status": ["active", "dissolved", "merged", "suspended"],
}
PERMITTED_ENDS = {
    "ownership": (["organization"], ["organization"]),
    "operational_control": (["organization"], ["organization", "facility"]),
    "legal_parentage": (["organization"], ["organization"]),
    "former_identity": (["organization"], ["organization"]),
    "beneficial_ownership": (["person"], ["organization"]),
    "supplies": (["organization"], ["organization"]),
    "subcontracts": (["organization"], ["organization"]),
    "tolls": (["organization", "facility"], ["organization"]),
    "distributes": (["organization"], ["organization"]),
    "brokers": (["organization"], ["organization"]),
    "operates": (["organization"], ["facility"]),
    "produces": (["facility"], ["good", "consignment"]),
    "composed_of": (["good", "consignment"], ["good", "consignment"]),
    "sells_to": (["organization"], ["organization"]),
    "attested_by": (["organization", "facility", "good", "consignment"], ["attestation"]),
}


def country_codes(spark) -> list[str]:
    """The officially assigned ISO 3166-1 alpha-2 codes, from the Java runtime."""
    return sorted(spark.sparkContext._jvm.java.util.Locale.getISOCountries())


def conform(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The columns of ``fields`` in order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])


def properties(**given):
    """A properties struct with the given columns; the others are null."""
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in PROPERTY_FIELDS.items()])


def identifier(scheme: str, value, authority=None, **more):
    """An identifier struct; the fields not given are null."""
    given = {"scheme": F.lit(scheme), "value": value, "authority": authority, **more}
    kind = T._parse_datatype_string(IDENTIFIER)
    return F.struct(*[(given[f.name] if given.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def label(key: str, value=None):
    return F.struct(F.lit(key).alias("key"), (F.lit(None) if value is None else value).cast("string").alias("value"))
