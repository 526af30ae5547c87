"""The kernels as functions of SQL: defined in SQL themselves, so that a query over them is one plan without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from amberlode.functions import similarity as S
from amberlode.functions import text as T


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name: parameters, type, expression."""
    a, b = T._table()
    accented = _literal(T.ACCENTED)
    return {
        "kb_fold": ("x STRING", "STRING", f"translate(coalesce(x, ''), {_literal(a)}, {_literal(b)})"),
        "kb_bare": ("x STRING", "STRING", rf"CASE WHEN rlike(coalesce(x, ''), {accented}) THEN regexp_replace(kb_fold(x), r'(?<=\p{{IsLatin}})\p{{Mn}}+', '') ELSE kb_fold(x) END"),
        "kb_normalize": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(kb_bare(x)), r'[^\p{L}\p{N}]+', ' '), r'(?<=\p{IsLatin}) (?:e|ye) (?=\p{IsLatin})', ' '))"),
        "kb_compact": ("x STRING", "STRING", "replace(kb_normalize(x), ' ', '')"),
        "kb_haversine": (
            "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE",
            f"2 * {S.EARTH_KM} * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2))))",
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes kb_normalize, kb_compact and kb_haversine known to the session; returns all names."""
    made = definitions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(made)
