"""Session settings and the one way lineage is cut: a table in the shared folder."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType


def build_session(app: str = "seqloom", cores: str | int = "*") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    parallelism = str(2 * int(os.cpu_count() if cores == "*" else cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        # rows here are small but costly: keep small shuffle partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or our own in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="seqloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The written table survives lost executors, has real size statistics (so Catalyst
    broadcasts only what is small) and lets later scans prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows from which a written table of a graph is no longer broadcast, whatever its files take.
BROADCAST_ROWS = 100_000


def materialise_graph(df: DataFrame, label: str) -> DataFrame:
    """``materialise`` for rows of numbers that repeat, as graphs have them.

    Their files are 10 to 50 times smaller than the rows in memory, and Catalyst would
    broadcast them by the size of the files. The rows are counted while they are written; a
    table of many is joined by sorting.
    """
    counted = Observation()
    table = materialise(df.observe(counted, F.count(F.lit(1)).alias("rows")), label)
    return table.hint("merge") if counted.get["rows"] > BROADCAST_ROWS else table


def kernel(result: DataType | str) -> Callable:
    """A pandas UDF that is evaluated once per row.

    Catalyst copies deterministic expressions into filters it infers (for example below an
    explode), which would run an expensive kernel twice.
    """
    return lambda function: F.pandas_udf(result)(function).asNondeterministic()


def spread(df: DataFrame) -> DataFrame:
    """Give an expensive row-local step work for every core.

    Rows are always dealt out: a file has more splits than row groups once it is large, and
    all rows of a row group come with one of them, so the number of splits tells nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * max(cores, df.rdd.getNumPartitions()))


def dealt(table: DataFrame, rows: int, key: str) -> DataFrame:
    """A written table over as many tasks as it needs at about ``rows`` rows each, by ``key``.

    For rows that are taken apart or sorted where they are read: splits of a file go by its bytes, which
    say little about the rows made of them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(4 * cores, math.ceil(table.count() / rows)), key)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom"), "zip", root, "seqloom"
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
