"""What held when: versions that a bump makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(rows: DataFrame, bump: Column, time: str, tie: str) -> DataFrame:
    """`rows` with version: one more than the bumps up to and including each row, in order of time and tie.

    The count runs within days, and the days' totals, one row a day, run over days; so no task sees all rows."""
    dated = rows.withColumn("_day", F.to_date(time)).withColumn("_bump", F.coalesce(bump, F.lit(False)).cast("long"))
    days = dated.groupBy("_day").agg(F.sum("_bump").alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_bump").over(Window.partitionBy("_day").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    return dated.withColumn("_within", within).join(before, "_day").withColumn("version", 1 + F.col("_before") + F.col("_within")).drop("_day", "_bump", "_within", "_before")


def cache_hits(lookups: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """`lookups` (with version) with cache_key and hit: whether the key was looked up before under the same version."""
    named = lookups.withColumn("cache_key", F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(":"), F.col(key)))
    return named.withColumn("hit", F.row_number().over(Window.partitionBy("cache_key").orderBy(time, tie)) > 1)
