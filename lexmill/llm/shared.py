"""What several operators need: tables cut from their lineage, and lambdas that bind a value once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where it is unset, one is made in local mode (one machine) only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = os.path.join(tempfile.gettempdir(), "lexmill-checkpoints")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows in the shared checkpoint folder: later plans do not recompute them, and they outlive executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, as Parquet: smaller, and columns can be pruned."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Tables:
    """Parquet tables of one job by name, which can be dropped when the next ones exist."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has such columns of its own (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A side of so few rows (of a few numbers each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def small_or_as_is(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks rows (already materialised, and narrow) for a broadcast if they are at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where lambdas inside use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
