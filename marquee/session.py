"""Session helpers: local session for tests, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def local_session(cpus: str | int = "*", app: str = "marquee", **conf: str) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARQUEE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and job tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    the setting gets a fresh temporary folder; a cluster session without it is
    an error, since executors could not reach a machine-local path.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="marquee-ckpt-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def job_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared folder for one job's tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/marquee-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: survives lost executors like a checkpoint.

    Unlike one it is columnar and compressed, and a reader takes the columns it needs.
    """
    folder = job_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension written in code, as a local relation rather than a Python RDD."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join on equal keys that grows with the input: never sent whole to the driver and all executors.

    A table written compressed looks small to the planner, and so do packed shuffle blocks;
    in memory they are many times as large.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by keys with the session's partition count, kept as it is.

    A later grouping on the keys needs no shuffle of its own. Unlike a plain
    shuffle it is not merged into fewer tasks when the rows are small: use it in
    front of work that is heavy per row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's partition count, whatever their values.

    A file of one row group is one task however many rows it holds: use it on the
    narrow rows in front of work that is heavy per row.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
