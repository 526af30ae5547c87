"""Retrieval for questions: ranked lists, fusion, citable items under a budget, answer gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amberlode.functions import text as T
from amberlode.sources.shared import BESIDE_ROWS, at_most, sent


def fused(lists: DataFrame, constant: int = 60) -> DataFrame:
    """key, score: reciprocal ranks summed over lists (list, key, rank from 0), each key once per list at its best rank."""
    once = lists.groupBy("list", "key").agg(F.min("rank").alias("rank"))
    return once.groupBy("key").agg(F.sum(1.0 / (constant + F.col("rank") + 1)).alias("score"))


def within_budget(items: DataFrame, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """Items (chars) of each group, in order, until `budget` characters have been reached; the one that reaches it counts."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("_used", F.coalesce(F.sum("chars").over(w), F.lit(0))).where(F.col("_used") < budget).drop("_used")


def gate(answer: Column, n_items: Column) -> Column:
    """answered, rejected_uncited or insufficient: an answer must cite, and only what was retrieved."""
    m = T.markers(answer)
    cited = (F.size(m) > 0) & F.forall(m, lambda x: (x >= 1) & (x <= n_items))
    return F.when(n_items == 0, "insufficient").when(cited, "answered").otherwise("rejected_uncited")


#: Passages of fewer words meet the texts on their characters: on all of them, or on the first GRAM where there are more.
INNER, GRAM = 5, 8


def quotes(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, at: 0-based offset of a normalised passage of three characters or more in a normalised text.

    The first and the last word of a passage may be parts of the text's words, the words between can't. So both sides
    meet on the passage's second to fourth word, or on characters where it has too few words."""
    p = passages.select("item_id", T.normalize(F.col("text")).alias("q")).where(F.length("q") >= 3).withColumn("w", T.tokens(F.col("q")))
    d = chunks.select("doc_id", T.normalize(F.col("text")).alias("n"))
    long = p.where(F.size("w") >= INNER).select("item_id", "q", F.get("w", F.lit(1)).alias("first"), F.array_join(F.slice("w", 2, 3), " ").alias("key"))
    # runs of three words, of which only those go on that begin like one of a passage
    firsts, words = long.select("first").distinct(), T.tokens(F.col("n"))
    if at_most(firsts, BESIDE_ROWS):
        beside = F.broadcast(firsts.agg(F.collect_set("first").alias("firsts")))
        cut = d.join(beside).select("doc_id", T.runs_from(words, F.col("firsts"), F.array(F.lit(3))).alias("keys"))
        runs = cut.where(F.size("keys") > 0).select("doc_id", F.explode("keys").alias("key"))
    else:
        threes = d.select("doc_id", F.array_distinct(T.let(words, lambda w: T.word_runs(w, 3))).alias("keys")).select("doc_id", F.explode("keys").alias("key"))
        runs = threes.join(sent(firsts), F.substring_index("key", " ", 1) == F.col("first"), "left_semi")
    short = p.where(F.size("w") < INNER).select("item_id", "q", F.substring("q", 1, GRAM).alias("key"))
    # windows only of the lengths that a passage has; the lookahead takes them all in one pass over the text
    lengths = short.select(F.length("key").alias("chars")).distinct()
    windows = F.regexp_extract_all("n", F.concat(F.lit("(?=(.{"), F.col("chars").cast("string"), F.lit("}))")), F.lit(1))
    grams = d.crossJoin(F.broadcast(lengths)).select("doc_id", F.explode(F.array_distinct(windows)).alias("key"))
    hit = runs.join(long.drop("first"), "key").select("doc_id", "item_id", "q").unionByName(grams.join(short, "key").select("doc_id", "item_id", "q")).distinct()
    # texts that meet no passage aren't normalised again, others once
    met = hit.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "q")).alias("met"))
    hit = met.join(chunks.select("doc_id", "text"), "doc_id").select("doc_id", T.normalize(F.col("text")).alias("n"), "met")
    hit = hit.select("doc_id", "n", F.inline("met"))
    return hit.withColumn("at", F.instr("n", F.col("q")) - 1).where("at >= 0").select("doc_id", "item_id", "at")
