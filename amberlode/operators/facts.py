"""Batch fact assertion: corroboration, conflicts, revisions, resolution, merges.

A batch is order-free where the one-by-one original isn't: the earliest (ts, id) represents equal claims, and conflict
state is that of all current rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberlode.functions import facts as FF


def corroborated(rows: DataFrame, key: list[str]) -> DataFrame:
    """One fact per (key, value): first assertion, distinct sources, highest status. Groups combine before the shuffle."""
    first = F.min_by("assertion_id", F.struct("ts", "assertion_id"))
    ranked = F.max(F.struct(FF.rank_of(F.col("status")).alias("r"), F.when(F.col("status") == "disputed", 0).otherwise(1).alias("d"), F.col("status").alias("s")))
    return rows.groupBy(*key, "value").agg(first.alias("fact_id"), F.countDistinct("source_id").alias("sources_count"), ranked.alias("m")).select(*key, "value", "fact_id", "sources_count", F.col("m.s").alias("status"))


def conflicts(facts: DataFrame, key: list[str]) -> DataFrame:
    """Keys with two or more distinct values among facts that aren't rejected."""
    return facts.where("status <> 'rejected'").groupBy(*key).agg(F.count("*").alias("n_values")).where("n_values > 1")


def resolved(facts: DataFrame, key: list[str], reject_others: bool = True) -> DataFrame:
    """Of each conflict the best supported fact is preferred; the others may be rejected."""
    w = Window.partitionBy(*key).orderBy(F.desc("sources_count"), "fact_id")
    marked = facts.withColumn("is_preferred", F.row_number().over(w) == 1)
    return marked.withColumn("status", F.when(F.col("is_preferred") | F.lit(not reject_others), F.col("status")).otherwise("rejected"))


def revisions(rows: DataFrame, key: list[str]) -> DataFrame:
    """Edits in order: a row only where the value differs from the one before, numbered from 1."""
    w = Window.partitionBy(*key).orderBy("ts", "assertion_id")
    changed = rows.withColumn("before", F.lag("value").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("value")))
    return changed.withColumn("revision", F.row_number().over(w))


def repointed(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """`column` through a mapping (old, new); rows that aren't mapped stay."""
    return rows.join(mapping, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def filled(old: Column, new: Column) -> Column:
    """A field takes a new value only while it is null or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), new)
