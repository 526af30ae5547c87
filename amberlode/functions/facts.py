"""Typed values, hashes and keys of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amberlode.functions import text as T

# The verification lattice.
RANKS = {"rejected": -1, "unverified": 0, "disputed": 0, "ai_extracted": 1, "source_verified": 2, "community_verified": 3, "expert_verified": 4}


def rank_of(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), status)


def at_least(status: Column, minimum: str) -> Column:
    """Statuses of at least this rank; disputed is none of them."""
    return status.isin([s for s, r in RANKS.items() if r >= RANKS[minimum] and s != "disputed"])


def is_public(status: Column, sources_count: Column, minimum: str = "source_verified") -> Column:
    return (at_least(status, minimum) | (status == "disputed")) & (sources_count > 0)


def is_unknown(value: Column) -> Column:
    return value.isNull() | (value == "__UNKNOWN__") | (F.upper(F.trim(value)) == "UNKNOWN")


def decimal_text(number: Column) -> Column:
    """A number with up to six places and no trailing zeros."""
    fixed = number.cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def value_normalized(datatype: Column, value: Column) -> Column:
    """The form of a value that equality is judged on; null if the value doesn't fit the type."""
    number = T.clean_number(value)
    year = F.regexp_extract_all(T.ascii_digits(F.trim(value)), F.lit(r"-?\d+"), 0)
    fits_year = T.ascii_digits(F.trim(value)).rlike(r"^-?\d+(\s*,\s*-?\d+)?$")
    return (
        F.when(is_unknown(value), "unknown")
        .when(datatype == "entity", F.concat(F.lit("entity:"), value))
        .when(datatype == "integer", F.when(number.isNotNull(), F.round(number).cast("long").cast("string")))
        .when(datatype == "decimal", F.when(number.isNotNull(), decimal_text(number)))
        .when(datatype == "year", F.when(fits_year, F.concat_ws("-", F.get(year, F.lit(0)), F.coalesce(F.get(year, F.lit(1)), F.get(year, F.lit(0))))))
        .when(datatype == "boolean", F.when(F.lower(F.trim(value)).isin("1", "true", "on", "yes"), "1").otherwise("0"))
        .when(datatype.isin("date", "json"), value)
        .otherwise(F.when(F.trim(value) != "", T.normalize(value)))
    )


def value_hash(datatype: Column, value: Column) -> Column:
    """SHA-256 of `type|normalized`; an unknown value hashes on its own."""
    return F.when(is_unknown(value), F.sha2(F.lit("unknown"), 256)).otherwise(F.sha2(F.concat(datatype, F.lit("|"), value_normalized(datatype, value)), 256))


def conflict_key(entity: Column, prop: Column, scope: Column, identifying: Column) -> Column:
    """Facts with equal keys compete. `identifying`: JSON of the identifying qualifiers in key order, or null if none."""
    digest = F.substring(F.sha2(F.coalesce(identifying, F.lit("[]")), 256), 1, 16)
    return F.concat_ws("|", entity.cast("string"), prop.cast("string"), F.coalesce(scope.cast("string"), F.lit("-")), digest)
