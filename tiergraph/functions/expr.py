"""Scalar functions over columns: everything stays inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encode(x: Column) -> Column:
    for raw, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("\r", "%0D")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def canonical(ident: Column) -> Column:
    """scheme:value, and scheme:authority:value for the schemes of registers and tax numbers."""
    scheme, value = percent_encode(ident["scheme"]), percent_encode(ident["value"])
    authority = percent_encode(F.coalesce(ident["authority"], F.lit("")))
    return F.when(ident["scheme"].isin("nat-reg", "vat"), F.concat_ws(":", scheme, authority, value)).otherwise(F.concat_ws(":", scheme, value))


def annulled(ident: Column) -> Column:
    """An LEI whose entity has been annulled identifies nothing any more."""
    return (ident["scheme"] == "lei") & F.coalesce(F.get_json_object(ident["extra"], "$.entity_status") == "ANNULLED", F.lit(False))


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def temporal_compatible(a: Column, b: Column) -> Column:
    """Validity ranges overlap, or one side has none. Null and absent ends are open."""
    dated = lambda x: x["valid_from"].isNotNull() | x["valid_to"].isNotNull() | F.coalesce(x["valid_to_present"], F.lit(False))
    before = lambda x, y: F.coalesce(x["valid_to"] < y["valid_from"], F.lit(False))
    return ~(dated(a) & dated(b)) | ~(before(a, b) | before(b, a))


def identifiers_match(a: Column, b: Column) -> Column:
    one, two = a["authority"].isNotNull(), b["authority"].isNotNull()
    same_authority = (~one & ~two) | (one & two & F.coalesce(ascii_lower(a["authority"]) == ascii_lower(b["authority"]), F.lit(False)))
    return (a["scheme"] != "internal") & (a["scheme"] == b["scheme"]) & (trimmed(a["value"]) == trimmed(b["value"])) & same_authority & temporal_compatible(a, b)


def any_match(a: Column, b: Column) -> Column:
    """Whether two arrays of identifiers have a matching pair."""
    return F.exists(F.coalesce(a, F.array()), lambda x: F.exists(F.coalesce(b, F.array()), lambda y: identifiers_match(x, y)))


def mod97(x: Column) -> Column:
    """ISO 7064 MOD 97-10 of digits and capital letters, a character a step."""
    code = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    step = lambda acc, c: F.when(code(c) > 9, (acc * 100 + code(c)) % 97).otherwise((acc * 10 + code(c)) % 97)
    return F.aggregate(F.split(x, ""), F.lit(0), step)


def gs1_valid(x: Column) -> Column:
    """The last of 13 digits checks the others, weighed 1 and 3 in turn."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda acc, i: acc + F.substring(x, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return (10 - total % 10) % 10 == F.substring(x, 13, 1).cast("int")


def lei_valid(x: Column) -> Column:
    return x.rlike("^[A-Z0-9]{18}[0-9]{2}$") & (mod97(x) == 1)


def real_date(x: Column) -> Column:
    """Whether a string of the shape yyyy-mm-dd is a day of the calendar."""
    return F.coalesce(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), F.lit(False))


def normalised_date(x: Column) -> Column:
    """Month and day of a string of three parts joined by dashes, as two digits."""
    parts = F.split(x, "-", 3)
    two = lambda p: F.when(F.ltrim(p, F.lit("0")).rlike("^[0-9]+$"), F.lpad(F.ltrim(p, F.lit("0")), 2, "0")).otherwise(F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p))
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[0], two(parts[1]), two(parts[2]))).otherwise(x)


def semver(x: Column) -> Column:
    return F.transform(F.split(x, r"\."), lambda p: p.cast("int"))


def slug(x: Column, prefix: str, limit: int = 48) -> Column:
    """Lower-case ASCII letters and digits, dashes between; null where nothing is left."""
    body = F.btrim(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
    body = F.rtrim(F.substring(body, 1, limit), F.lit("-"))
    return F.when(body != "", F.concat(F.lit(prefix + "-"), body))


def type_name(x: Column) -> Column:
    """The order of edge types in a merged snapshot is by their name in camel case."""
    from tiergraph.schema import EDGE_TYPES

    return F.when(x.isin(EDGE_TYPES), F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))).otherwise(x)


def geo_point(geo: Column) -> Column:
    """(lat, lon, kind, problem) of a JSON position: a point, GeoJSON, or what is wrong."""
    lat, lon, kind = (F.get_json_object(geo, p) for p in ("$.lat", "$.lon", "$.type"))
    problem = (
        F.when(~geo.startswith("{"), "not an object")
        .when(kind.isNotNull(), None)
        .when(lat.isNull() | lon.isNull(), "neither a point nor GeoJSON")
        .when(lat.try_cast("double").isNull() | lon.try_cast("double").isNull(), "coordinates are not numbers")
    )
    return F.struct(lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon"), kind.alias("kind"), problem.alias("problem"))


def sensitivity(ident: Column, node_type: Column) -> Column:
    """What an identifier says, else confidential for persons, else by scheme."""
    default = F.when(ident["scheme"].isin("nat-reg", "vat", "internal"), "restricted").otherwise("public")
    return F.coalesce(ident["sensitivity"], F.when(node_type == "person", "confidential"), default)


def property_sensitivity(name: str, edge_type: Column, extra: Column) -> Column:
    said = F.get_json_object(extra, f"$._property_sensitivity.{name}")
    if name in ("contract_ref", "annual_value", "value_currency", "volume"):
        default = F.lit("restricted")
    elif name == "percentage":
        default = F.when(edge_type == "beneficial_ownership", "confidential").otherwise("public")
    else:
        default = F.lit("public")
    return F.coalesce(F.when(said.isin("public", "restricted", "confidential"), said), default)


def allowed(level: Column, scope: str) -> Column:
    """internal takes all, partner all but confidential, public just public."""
    return F.lit(True) if scope == "internal" else level != "confidential" if scope == "partner" else level == "public"


def boundary_hash(public_canonicals: Column, salt_hex: Column) -> Column:
    """SHA-256 of the sorted canonical identifiers, a line each, and the salt."""
    text = F.encode(F.array_join(F.array_sort(public_canonicals), "\n"), "UTF-8")
    return F.sha2(F.concat(text, F.unhex(salt_hex)), 256)


def bits(x: Column) -> Column:
    """A double as text that keeps apart what its bits keep apart, for keys."""
    return x.cast("string")
