"""The state store that processors with timers need."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocks(spark: SparkSession) -> None:
    """Raise unless the session's state store is RocksDB; the setting is the caller's."""
    if spark.conf.get(PROVIDER, None) != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS} before starting this stream")
