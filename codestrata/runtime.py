"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the one the cluster names in
    spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return tempfile.gettempdir() + "/codestrata-checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder. Later reads see fixed
    partitions in a fixed order, and survive the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def retry(work: Callable[[], T], attempts: int = 4, first_wait: float = 0.5, retriable: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)) -> T:
    """Call something outside that may fail for a moment; waits double."""
    for k in range(attempts):
        try:
            return work()
        except retriable:
            if k == attempts - 1:
                raise
            time.sleep(first_wait * 2**k)
    raise ValueError("at least one attempt")


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One side of a join, materialised and counted: sent to all executors if it
    has at most `most_rows` rows, joined by shuffle otherwise. For narrow rows."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def spread(df: DataFrame) -> DataFrame:
    """A scan with a partition for every core before heavy work on its rows, if
    more than half of the cores had none: fewer aren't worth a shuffle. Only for
    scans with projections and filters, whose partitions are known without a job."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
