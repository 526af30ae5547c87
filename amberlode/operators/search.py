"""Keyword search over search documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberlode.functions import text as T

# Base weights of place kinds.
BOOSTS = {"province": 1.6, "county": 1.6, "city": 1.6, "district": 1.3, "island": 1.3, "port": 1.3, "village": 1.0, "rural_district": 1.0, "mountain": 0.8, "natural_feature": 0.8}


def boost(kind: Column, facts: Column) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv]), kind), F.lit(1.1))
    return base + F.least(F.lit(0.5), facts / 40.0)


def documents(entities: DataFrame, aliases: DataFrame, lines: DataFrame) -> DataFrame:
    """One search document per entity that isn't merged: what searches read, written once, so that no query normalises text.

    entities: id, title, parent_title, type, facts (their number) and merged_into_id, whatever columns besides; aliases:
    entity_id, alias, historical - every name, old ones included; lines: entity_id, line - a line for each public fact.
    Adds normalized_title; aliases and compact_text, the distinct normalised and compact forms of all names; body, the
    parent and the lines; normalized_text, all of it; and boost."""
    names = aliases.select("entity_id", T.normalize(F.col("alias")).alias("n")).where("n <> ''")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    named = names.groupBy(F.col("entity_id").alias("id")).agg(joined("n").alias("aliases"), joined(F.replace("n", F.lit(" "), F.lit(""))).alias("compact_text"))
    told = lines.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("told"))
    e = entities.where("merged_into_id IS NULL").join(named, "id", "left").join(told, "id", "left")
    e = e.withColumn("body", F.concat_ws("\n", "parent_title", "told")).drop("told")
    e = e.withColumns({"normalized_title": T.normalize(F.col("title")), "normalized_text": T.normalize(F.concat_ws(" ", "title", "aliases", "body")), "boost": boost(F.col("type"), F.col("facts"))})
    return e.fillna("", ["aliases", "compact_text"])


def matches(q_norm: str) -> Column:
    """All of the first eight tokens occur, or the whole compact query of three or more characters is in a compact name."""
    words, whole = q_norm.split()[:8], q_norm.replace(" ", "")
    every = reduce(lambda x, w: x & F.col("normalized_text").contains(w), words, F.lit(True))
    return every | F.col("compact_text").contains(whole) if len(whole) >= 3 else every


def phrases(q_norm: str) -> Column:
    """Boolean full text: every word of the query is a whole word of the text, or the compact query is in a compact name."""
    words, whole = q_norm.split(), q_norm.replace(" ", "")
    padded = F.concat(F.lit(" "), F.col("normalized_text"), F.lit(" "))
    every = reduce(lambda x, w: x & padded.contains(f" {w} "), words, F.lit(True))
    return every | F.col("compact_text").contains(whole) if len(whole) >= 3 else every


def frequency(q_norm: str) -> Column:
    """Full-text relevance: occurrences of the query's words as whole words, damped by the text's length."""
    tokens = T.tokens(F.col("normalized_text"))
    hits = T.let(tokens, lambda ws: F.size(F.filter(ws, lambda w: w.isin(q_norm.split()))) / F.greatest(F.lit(1), F.size(ws)))
    return F.when(F.col("normalized_text") == "", 0.0).otherwise(hits)


def score(q_norm: str, full_text: bool = False) -> Column:
    """How the title holds the query, how the names do, and how many of its words the text holds, times the boost; a full-text
    search adds its own relevance."""
    words, whole, title = q_norm.split()[:8], q_norm.replace(" ", ""), F.col("normalized_title")
    s = F.when(title == q_norm, 10.0).when(title.startswith(q_norm), 6.0).when(title.contains(q_norm), 4.0).otherwise(0.0)
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    named = padded("aliases").contains(f" {q_norm} ") | padded("compact_text").contains(f" {whole} ")
    s = s + F.when(named, 7.0).when(F.col("compact_text").contains(whole), 3.0).otherwise(0.0)
    for w in q_norm.split() if full_text else words:
        s = s + F.when(F.col("normalized_text").contains(w), 1.0).otherwise(0.0)
    return s * F.col("boost") + (frequency(q_norm) if full_text else F.lit(0.0))


def within(docs: DataFrame, ancestor: int) -> DataFrame:
    """Documents at the place or below it: one equality on the exploded path would do for many ancestors; for one, a filter."""
    return docs.where(F.array_contains(F.split("path", "/"), str(ancestor)))


def search(docs: DataFrame, q_norm: str, k: int) -> DataFrame:
    """id, score (4 places), rank of the best k; ties to the smaller id. An empty query finds nothing."""
    found = docs.where(matches(q_norm) & F.lit(q_norm != "")).select("id", F.round(score(q_norm), 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
