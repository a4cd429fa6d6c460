"""Values of an item's claims: times, coordinates, items and strings of its preferred or else first statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def claim_value(entity: Column, prop: str) -> Column:
    """The value (variant) of a property of an entity (variant): of its statements the first preferred, else the first.
    Null if there is none."""
    statements = F.try_variant_get(entity, f"$.claims.{prop}", "array<variant>")
    preferred = F.filter(statements, lambda s: F.try_variant_get(s, "$.rank", "string") == "preferred")
    picked = F.coalesce(F.get(preferred, F.lit(0)), F.get(statements, F.lit(0)))
    return F.try_variant_get(picked, "$.mainsnak.datavalue.value", "variant")


def _member(value: Column, name: str, kind: str, pattern: str) -> Column:
    """A member of an object, null if it is of another kind."""
    member = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(_kind(member).rlike(pattern), F.try_variant_get(member, "$", kind))


def claim_time(entity: Column, prop: str) -> Column:
    """struct<time, precision>; null if either is missing or of another kind."""
    value = claim_value(entity, prop)
    time, precision = _member(value, "time", "string", "^STRING"), _member(value, "precision", "int", "^BIGINT")
    return F.when(time.isNotNull() & precision.isNotNull(), F.struct(time.alias("time"), precision.alias("precision")))


def claim_coordinate(entity: Column, prop: str = "P625") -> Column:
    """struct<latitude, longitude>; null if either is missing or no number."""
    value = claim_value(entity, prop)
    latitude, longitude = (_member(value, c, "double", _NUMBERS) for c in ("latitude", "longitude"))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def claim_item(entity: Column, prop: str) -> Column:
    return _member(claim_value(entity, prop), "id", "string", "^STRING")


def claim_string(entity: Column, prop: str) -> Column:
    value = claim_value(entity, prop)
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
