"""What the operators of this package share: durable intermediate tables, row keys and word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.sources.shared import durable, remove, scratch, shared_dir  # noqa: F401

#: ASCII white space, the only separator of words and the only thing stripped from lines.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as the characters that SQL's trim() strips.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of `docs` as one struct, `row`, and the columns `more` beside it, so that no name of a user's column can
    clash with one of an operator's."""
    return docs.select(F.struct(*[docs["`{}`".format(c.replace("`", "``"))].alias(c) for c in docs.columns]).alias("row"), *more)


def unboxed(columns: list[str], **instead: Column) -> list[Column]:
    """The columns of a boxed row again, those in `instead` replaced."""
    return [instead.get(c, F.col("row").getField(c)).alias(c) for c in columns]


#: Keys that hold more than one row in so many are fewer than this, whatever the table: what they carry can be broadcast.
HEAVY_SHARE = 10_000


def with_keys(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int | None = None) -> DataFrame:
    """`rows` joined with `found`, a table written by `durable`, which has one row per key and in `weight` a number no larger
    than the key's rows. `total`: the rows, where it is known.

    A key of more than one `HEAVY_SHARE`-th of all rows is met by broadcast - there are fewer than `HEAVY_SHARE` such keys -
    and its rows stay where they are; the others meet by a merge join in which no key is crowded."""
    least = max(1, (rows.count() if total is None else total) // HEAVY_SHARE)
    heavy, light = (found.where(x).drop(weight) for x in (F.col(weight) > least, F.col(weight) <= least))
    if heavy.isEmpty():
        return rows.join(light.hint("merge"), keys)
    met = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys)
    return met.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body(value)`, inside one expression."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of `text`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text, as two longs; equal texts, and null with itself only, have equal keys."""
    return F.struct(F.xxhash64(text, F.lit(11)).alias("a"), F.xxhash64(F.lit(23), text).alias("b"))
