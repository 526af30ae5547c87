"""Tables in the folder that driver and executors share, for work that goes in rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local master, whose executors are the
    driver itself, gets one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(prefix="amberlode-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths that `scratch` gave out and nothing has swept.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _GIVEN.append(f"{shared_dir(spark)}/amberlode/{name}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def remove(spark: SparkSession, written: DataFrame | str) -> None:
    """Delete a table that `durable` wrote, or a path, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written if isinstance(written, str) else written.__dict__["_written_at"])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """`durable` of what `make` returns; all tables that were written on the way are deleted once it stands."""
    before = len(_GIVEN)
    out = durable(make(), name)
    for path in _GIVEN[before:-1]:
        remove(spark, path)
    _GIVEN[before:] = _GIVEN[-1:]
    return out


#: Rows of narrow tables (keys and short strings) that may be sent to every executor, some 100 MB at most, and of those
#: that may stand beside every row.
SENT_ROWS, BESIDE_ROWS = 1_000_000, 10_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` holds no more than `rows` rows, without counting the rest."""
    return df.limit(rows + 1).count() <= rows


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """`df` marked for a broadcast if it was counted to hold no more than `rows` rows, else as it is: a shuffle then."""
    return F.broadcast(df) if at_most(df, rows) else df
