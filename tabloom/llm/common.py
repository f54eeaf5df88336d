"""What several operators need: written tables in the shared folder, size-checked joins, temporary names."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Rows and bytes on disk up to which the small side of a join is broadcast; they are measured before, beyond them the join
#: shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_down(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that driver and executors share (``spark.checkpoint.dir``).

    Later steps read the files: nothing above them is computed twice, numbers given to rows stay as they are, and a
    lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Delete the files of a table of ``write_down`` that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_in_arrow(df: DataFrame) -> DataFrame:
    """``df``, whose texts are going to Python: a batch is limited by rows, so the session's limit is lowered for them.

    At the usual limit of 10,000 rows a batch of texts takes tens of megabytes, several times over, beside the heap.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def small(df: DataFrame) -> DataFrame:
    """Mark rows of a written table for broadcast if they and its files are small, else leave the plan to Spark."""
    if df.count() > BROADCAST_ROWS:
        return df
    spark, size = df.sparkSession, 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def free_name(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, or that with a number, so that it clashes with none of ``columns`` in any case."""
    taken, name, k = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        k += 1
        name = f"{wanted}_{k}"
    return name


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def spread(rows: int, each: int, least: int = 1) -> int:
    """Number of partitions that leaves about ``each`` rows in one, but not fewer than ``least``."""
    return max(least, math.ceil(rows / each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
