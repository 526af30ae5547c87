"""Quality rules with cross-document line frequency. DataFrame functions only.

Rules on the text itself come first. Then normalised lines are hashed together with their host, and the distinct
documents of each host that hold a line are counted; a line that more than `least_docs` of them hold is boilerplate,
however large the host. It is removed from every text but that of the smallest doc_id that holds it (and from that
one too if `spare_first` is False), so that no passage vanishes with all its copies. A document that loses more than
`most_lost` per cent of the characters of its distinct lines is depleted and rejected.

Defined results: null or blank text has zero words and fails; a null host is a host; rows without doc_id are judged
like others, aren't counted and come last where a line's first holder is sought; rows that share a doc_id count as one
document and are judged on their own; repeated rows are judged alike; other columns are ignored, or returned as they
are where rows are returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlode.llm.common import SPACE_CHARS, boxed, durable, let, text_key, unboxed, with_keys, words_of


@dataclass(frozen=True)
class Params:
    least_words: int = 50
    most_repeated: int = 50
    least_chars: int = 20
    least_docs: int = 20
    most_lost: int = 70
    spare_first: bool = True


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that the text has twice or more; by 64-bit window hashes, sorted only where one repeats."""

    def covered(hashes: Column) -> Column:
        def runs(s: Column) -> Column:
            again = F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False)))
            starts = F.array_sort(F.transform(again, lambda e: e["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), runs)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, of)


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def line_hash(host: Column, normal: Column) -> list[Column]:
    """128 bits of a line within its host."""
    return [F.xxhash64(F.lit(3), host, F.lit(7), normal).alias("h1"), F.xxhash64(normal, F.lit(5), host).alias("h2")]


def base_rules(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, source, a, b (text key), the counts, base_failed, and lines: hashes and lengths of the distinct long lines."""
    text, host = F.coalesce("text", F.lit("")), F.col("source").cast("string")
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    normal = F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: F.length(x) >= p.least_chars)
    hashed = F.array_distinct(F.transform(normal, lambda x: F.struct(*line_hash(host, x), F.length(x).alias("chars"))))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), host.alias("source"), text_key(F.col("text")).alias("t"), let(words_of(F.col("text")), counts).alias("c"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), hashed.alias("lines"),
    )
    failed = (F.col("c.n_words") < p.least_words) | (100 * F.col("c.n_repeat_words") > p.most_repeated * F.col("c.n_words"))
    return rows.select("doc_id", "source", "t.a", "t.b", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", failed.alias("base_failed"), "lines")


#: What tells rows apart: rows that agree in these are judged alike.
_KEY = ["doc_id", "source", "a", "b"]


def lost_lines(rules: DataFrame, p: Params) -> DataFrame:
    """doc_id, source, a, b, depleted and lost (hashes of the boilerplate lines) of the documents that lose any; `rules` as from `base_rules`."""
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    lines = rules.where(F.size("lines") > 0).select(*_KEY, total.alias("total"), "lines").select(*_KEY, "total", F.explode("lines").alias("x")).select(*_KEY, "total", "x.*")
    # a document counts once per line, and a common line is counted by parts before its parts meet
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.min(F.struct("a", "b")).alias("t"))
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("holder")
    frequent = per_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), holder).where(F.col("n") > p.least_docs)
    limited = frequent.select("h1", "h2", "n", F.col("holder.t.a").alias("ha"), F.col("holder.t.b").alias("hb"))
    gone = with_keys(lines, durable(limited, "limited"), ["h1", "h2"], "n")
    if p.spare_first:
        gone = gone.where("NOT (a = ha AND b = hb)")
    gone = gone.select(*_KEY, "total", "h1", "h2", "chars").distinct().groupBy(*_KEY, "total").agg(F.sum("chars").alias("chars"), F.collect_list(F.struct("h1", "h2")).alias("lost"))
    return gone.select(*_KEY, (100 * F.col("chars") > p.most_lost * F.col("total")).alias("depleted"), "lost")


def _same(left: list[str], right: list[str]) -> str:
    return " AND ".join(f"{x} <=> {y}" for x, y in zip(left, right))


def judged(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of `docs` (doc_id, text, source)."""
    rules = durable(base_rules(docs, p), "rules")
    gone = lost_lines(rules, p).where("depleted").select(*_KEY, F.lit(True).alias("gone"))
    out = rules.drop("lines").alias("l").join(gone.alias("r"), F.expr(_same([f"l.{c}" for c in _KEY], [f"r.{c}" for c in _KEY])), "left")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*[F.col(f"l.{c}") for c in names], (~F.col("l.base_failed") & F.col("r.gone").isNull()).alias("kept"))


def passing(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of `docs` that pass every rule, their texts without boilerplate lines, all other columns as they are."""
    rules = durable(base_rules(docs, p), "rules")
    lost = lost_lines(rules, p)
    failed = rules.where("base_failed").select(*_KEY, F.lit(True).alias("depleted"), F.lit(None).cast(lost.schema["lost"].dataType).alias("lost"))
    marks = lost.unionByName(failed).groupBy(*_KEY).agg(F.max("depleted").alias("bad"), F.first("lost", ignorenulls=True).alias("lost"))
    key, text, host = text_key(F.col("text")), F.col("row.text"), F.col("k_source")
    keyed = boxed(docs, F.col("doc_id").cast("long").alias("k_doc_id"), F.col("source").cast("string").alias("k_source"), key["a"].alias("k_a"), key["b"].alias("k_b"))
    joined = keyed.join(marks, F.expr(_same([f"k_{c}" for c in _KEY], _KEY)), "left").where("NOT coalesce(bad, false)")
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("lost"), F.struct(*line_hash(host, normal_line(x)))))
    return joined.select(*unboxed(docs.columns, text=F.when(F.col("lost").isNull(), text).otherwise(F.array_join(rest, "\n"))))
