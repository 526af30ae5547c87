"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line hashes, bucketed and sorted by hash, so that runs meet by merge without being moved again. The
documents come in batches. A batch's lines become one row per hash, are put into the runs' buckets once, and are
merge-anti-joined with every run: hashes that no run holds are the batch's own run at level 0, so runs never share a
hash; of hashes that a run does hold, the number of further documents and the largest doc_id go to a run of repeats.
`fanout` runs of a level are compacted into one of the next, repeats by adding up. In the end each run is
merge-joined with the repeats, and lines whose hash is crowded go, but in the largest document that holds them.

Defined results: null or empty text is one empty line; rows without doc_id keep all lines and aren't counted; rows
that share a doc_id count as one document and each keep or lose lines on their own; other columns pass through
where rows are returned, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.llm.common import SPACE_CHARS, ascii_lower, boxed, durable, remove, scratch, text_key, unboxed, with_keys

_HASH = ["h1", "h2"]


@dataclass(frozen=True)
class Params:
    """Keys of `least_chars` code points or more that `least_docs` documents hold are crowded. Documents come in `batches`;
    a bucket of a run is planned for `bucket_lines` lines of a batch."""

    least_chars: int = 20
    least_docs: int = 3
    batches: int = 5
    fanout: int = 4
    bucket_lines: int = 2_000_000


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z in lower case; text that is all ASCII takes the faster function."""
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def lines_of(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, a, b (text key), pos, h1, h2 of every line whose key is long enough."""
    key = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(F.length(x) >= p.least_chars, line_key(x)))
    hashed = F.transform(key, lambda k: F.when(F.length(k) >= p.least_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    # the text ends here: what stands beside a generator is evaluated, and carried, for every row that it makes
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("t"), hashed.alias("hs"))
    rows = rows.select("doc_id", "t", F.posexplode("hs").alias("pos", "h"))
    return rows.where("h IS NOT NULL").select("doc_id", "t.a", "t.b", "pos", "h.h1", "h.h2")


#: Buckets that are one sorted file each, as those of runs are, keep their order; and no union of bucketed scans counts as
#: partitioned, since Spark 4.1 reads such a union in columns without lining its buckets up.
_SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def _planning(spark: SparkSession) -> Iterator[None]:
    """Has what runs inside planned under `_SETTINGS`."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """Levelled sorted runs of hashes, each hash in one of them, and levelled runs of what is known of their repeats."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Names of the runs of each level.
        self.levels: list[list[str]] = []
        self.repeats: list[list[str]] = []
        self.made: dict[str, str] = {}

    def add(self, batch: DataFrame) -> None:
        """Adds the lines of a batch (doc_id, h1, h2); no document may be in two batches."""
        held = batch.select("doc_id", *_HASH).distinct().groupBy(*_HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        name = self._written(held)
        if not self.levels:
            return self._put(self.levels, name, 0)
        mine = self.spark.table(name)
        fresh = self._written(self.unseen(mine), moved=False)
        known = mine.join(self.spark.table(fresh).select(*_HASH).hint("merge"), _HASH, "left_anti")
        again = self._written(known, moved=False)
        self._drop(name)
        self._put(self.levels, fresh, 0)
        self._put(self.repeats, again, 0)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose hash no run holds."""
        return reduce(lambda b, run: b.join(run.select(*_HASH).hint("merge"), _HASH, "left_anti"), self._runs(self.levels), batch)

    def all(self) -> DataFrame | None:
        """h1, h2, n_docs and last_doc of every hash: runs are disjoint, and each meets the repeats by merge. To be read
        under `_planning`."""
        if not self.levels:
            return None
        repeats = self._runs(self.repeats)
        if not repeats:
            return self._runs(self.levels)[0]
        more = repeats[0] if len(repeats) == 1 else self.spark.table(self._written(self._sums(repeats)))
        more = more.select(*_HASH, F.col("n_docs").alias("more_docs"), F.col("last_doc").alias("later_doc")).hint("merge")
        count, last = F.col("n_docs") + F.coalesce("more_docs", F.lit(0)), F.greatest("last_doc", "later_doc")
        return reduce(DataFrame.unionByName, [run.join(more, _HASH, "left").select(*_HASH, count.alias("n_docs"), last.alias("last_doc")) for run in self._runs(self.levels)])

    def drop(self) -> None:
        """Deletes all runs, once nothing reads them."""
        for name in list(self.made):
            self._drop(name)

    def _runs(self, levels: list[list[str]]) -> list[DataFrame]:
        return [self.spark.table(name) for level in levels for name in level]

    def _put(self, levels: list[list[str]], name: str, level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fanout:
            old, levels[level] = levels[level], []
            runs = [self.spark.table(x) for x in old]
            merged = self._written(self._sums(runs) if levels is self.repeats else reduce(DataFrame.unionByName, runs))
            for x in old:
                self._drop(x)
            self._put(levels, merged, level + 1)

    @staticmethod
    def _sums(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _written(self, rows: DataFrame, moved: bool = True) -> str:
        """Writes rows as a table of one sorted file per bucket; rows that came from runs alone lie right already."""
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        rows = rows.repartition(self.buckets, *_HASH) if moved else rows
        with _planning(self.spark):
            rows.sortWithinPartitions(*_HASH).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        self.made[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self.made.pop(name))


def lost_lines(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, a, b, lost: positions of the lines that each text loses; texts that lose none have no row."""
    spark = docs.sparkSession
    lines = durable(lines_of(docs, p), "lines")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // (p.bucket_lines * p.batches)))
    runs = LineRuns(spark, p.fanout, buckets)
    for k in range(p.batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(p.batches)) == k).select("doc_id", *_HASH))
    with _planning(spark):
        crowded = durable(runs.all().where(F.col("n_docs") >= p.least_docs), "crowded")
    runs.drop()
    gone = with_keys(lines, crowded, _HASH, "n_docs").where("doc_id < last_doc")
    return gone.groupBy("doc_id", "a", "b").agg(F.collect_set("pos").alias("lost"))


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """`docs` with columns kept_text, n_lines and n_dropped, which take the place of columns of these names; a text that was
    null stays null if nothing was dropped."""
    lost = lost_lines(docs, p).withColumnRenamed("doc_id", "id")
    key = text_key(F.col("text"))
    keyed = boxed(docs, F.col("doc_id").cast("long").alias("k_id"), key["a"].alias("k_a"), key["b"].alias("k_b"))
    joined = keyed.join(lost, F.expr("k_id = id AND k_a = a AND k_b = b"), "left")
    text = F.col("row.text")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lost")), lambda i: F.get(x, i)), "\n"))[0]
    added = {
        "kept_text": F.when(F.col("lost").isNull(), text).otherwise(kept),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("lost"), F.lit(0)).cast("long"),
    }
    return joined.select(*unboxed([c for c in docs.columns if c not in added]), *[x.alias(c) for c, x in added.items()])


def cleaned(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of `docs`, their texts without the lines they lose, all other columns as they are."""
    box = boxed(docs, "doc_id", "text")
    return deduplicated(box, p).select(*unboxed(docs.columns, text=F.col("kept_text")))


def line_digests(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    out = deduplicated(docs.select("doc_id", "text"), p)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
