"""Session settings and the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: str | int = "*", app: str = "tabloom", checkpoints: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python line of every expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoints and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoints)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session's checkpoints: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    No folder is made up: one of a single machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return current


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and read it from there.

    Used for dictionaries and other aggregates that several later steps read: their rows stay the same even when
    executors are lost, and the scan below them is not repeated.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet and read from there, column by column as it is needed.

    An error in any row shows here, and what reads the result does not repeat the work above it.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation: planned as constants, with a known size and without a job."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)
