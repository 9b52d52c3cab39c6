"""Joins with a table that has one row per key, where some keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 512


def meet(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with `table`, whose keys `on` are unique and never null.

    A key of more than one in SHARE of the rows meets its entry by broadcast: there are fewer than
    SHARE such keys, whatever the data. All others meet by a shuffled join, so no task holds more
    than about that share of one key. rows is read several times and should be a written table.
    """
    total = rows.count()
    often = rows.groupBy(*on).agg(F.count("*").alias("often_rows")).filter(F.col("often_rows") > max(total // SHARE, SHARE)).drop("often_rows")
    often = often.join(table, on).withColumn("met_often", F.lit(True))
    fields = [c for c in table.columns if c not in on]
    first = rows.join(F.broadcast(often), on, "left")
    hot = first.filter("met_often").drop("met_often")
    rest = first.filter("met_often IS NULL").drop("met_often", *fields)
    return hot.unionByName(rest.join(table, on))
