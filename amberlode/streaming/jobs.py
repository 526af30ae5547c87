"""Structured Streaming counterparts of the queued and scheduled jobs.

Sources are files; sinks upsert through foreachBatch or append. Every job can run with trigger(availableNow=True),
which is how a scheduled micro-batch is run, and each has a batch twin that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from amberlode.operators import pipeline as P


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what has arrived, exactly once across restarts as far as the sink is idempotent by batch id."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def chunk_stream(docs: DataFrame, size: int = 3500, overlap: int = 300) -> DataFrame:
    """fetch -> text -> chunks: rows (doc_id, seq, page, text, text_hash) for an upsert by (doc_id, seq)."""
    return P.chunks(docs, "doc_id", size, overlap).withColumn("text_hash", F.sha2("text", 256))


def upsert(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key in a table of one folder per batch: a batch that is run again replaces
    its own folder, and readers take the row of the latest batch (see `current`)."""

    def sink(df: DataFrame, batch: int) -> None:
        df.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that `upsert` keeps."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def routed(candidates: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Candidates (event_type, value) with the table that they go to and whether a person should look first."""
    route = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in routes.items()], F.lit("entity"))
    return candidates.withColumn("route", route).withColumn("state", F.when(F.col("value") / 100 < 0.6, "low_confidence").otherwise("in_review"))


def hourly_quality(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and type, closed once the watermark passes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def distinct_content(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """The first arrival of each content hash within the watermark."""
    return docs.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def evidence(rows: DataFrame) -> DataFrame:
    """property, value, evidence, state: distinct sources so far, by update-mode aggregation; state stays small per key."""
    return rows.groupBy("property", "value").agg(F.size(F.collect_set("source_id")).alias("evidence")).withColumn("state", F.when(F.col("evidence") >= 2, "in_review").otherwise("needs_evidence"))


_STATE = "values array<string>, sources array<long>"
_OUT = "entity_id long, property string, qualifier string, n_values int, n_sources int, in_conflict boolean"


def conflict_state(rows: DataFrame) -> DataFrame:
    """Corroboration and conflict per key as assertions arrive: distinct unrejected values and sources."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, sources = (set(x) for x in state.get) if state.exists else (set(), set())
        for b in batches:
            b = b[b["status"] != "rejected"]
            values |= set(b["value"])
            sources |= set(b["source_id"].astype(int))
        state.update((sorted(values), sorted(sources)))
        yield pd.DataFrame([[*key, len(values), len(sources), len(values) > 1]], columns=["entity_id", "property", "qualifier", "n_values", "n_sources", "in_conflict"])

    return rows.groupBy("entity_id", "property", "qualifier").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n of activity sessions; with `late` for streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
