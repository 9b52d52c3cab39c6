"""Session set-up for local runs, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trackmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\[]*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="trackmill-"))
    return sc.getCheckpointDir()


#: Rows of one task, where a step's memory follows them.
ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that keep ROWS_PER_TASK, at least the shuffle partitions, which do not follow the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hand_over(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    For loops: a checkpoint keeps the size that the plan before it was estimated at, and estimates of
    joins multiply, so after some rounds they have millions of digits. A written table has its own size.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
