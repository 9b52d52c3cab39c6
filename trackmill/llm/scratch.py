"""Hand-over tables in the folder that all executors share.

The folder is the one named by spark.checkpoint.dir. A written table outlives the
executors that made it, is columnar, and can be dropped as soon as it is used up.
"""

from __future__ import annotations

import contextlib
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from trackmill.session import shared_folder

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for as long as a table is written."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """A folder of Parquet tables for one run of one operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = shared_folder(spark)
        self.root = f"{root if urlparse(root).scheme else 'file://' + root}/{uuid.uuid4().hex}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as table `name` and return the written table; its shuffle files go at once."""
        with setting(self.spark, CLEAN, "true"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that df has no column of."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
