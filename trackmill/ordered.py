"""Ordered computations that never put a whole key into one task.

A plain window partitioned by recording runs one task per recording, so one
recording with a third of all rows decides the run time. Everything here splits
each key into *blocks* that follow the order, works inside (key, block), and
carries a one-row summary per block across. Blocks come either from a fixed
width of the time axis (`time_block`) or, for orders that are not time, from
Spark's range partitioning (`in_ranges`), as many as there are shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.session import cut_lineage

BLK = "_blk"
LEAST_RANGES = 16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_block(t: str | Column, width: int) -> Column:
    return F.floor(col(t) / F.lit(width)).cast("bigint")


def with_time_halo(df: DataFrame, t: str, width: int, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Copy each row into every block whose rows may look at it.

    A row of block b sees `lookback` before and `lookahead` after the block, so
    only rows near a block's edge are copied. `_core` marks the owning block.
    """
    first = time_block(F.col(t) - lookahead, width)
    last = time_block(F.col(t) + lookback, width)
    return df.withColumn(BLK, F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col(BLK) == time_block(t, width)
    )


def in_ranges(df: DataFrame, order: Sequence[Column | str], n: int | None = None) -> DataFrame:
    """df, materialised, with BLK: the ordinal of the value range a row falls in.

    Spark picks the ranges for about equal row counts. Rows equal in `order` share a range, and a
    row's range is stored with it, so every later use agrees.
    """
    n = n or max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *[col(c) for c in order])
    return cut_lineage(ranged.withColumn(BLK, F.spark_partition_id().cast("bigint")))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)


def with_prefix_sum(df, keys, block, order, value, name) -> DataFrame:
    """Inclusive running sum of `value` per key."""
    d = df.withColumn(BLK, block)
    totals = d.groupBy(*keys, BLK).agg(F.sum(col(value)).alias("_tot"))
    carry = totals.select(*keys, BLK, F.coalesce(F.sum("_tot").over(_before(keys)), F.lit(0)).alias("_carry"))
    w = Window.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn("_run", F.sum(col(value)).over(w)).join(carry, [*keys, BLK])
    return out.withColumn(name, F.col("_run") + F.col("_carry")).drop("_run", "_carry", BLK)


def with_ordinal(df, keys, block, order, name) -> DataFrame:
    """row_number() per key; `order` must be a total order."""
    return with_prefix_sum(df, keys, block, order, F.lit(1), name)


def with_rank_order(df, keys, order, name) -> DataFrame:
    """row_number() per key for an order that is not time.

    The rows are materialised once, in ranges, then counted per range and
    numbered, so nothing upstream runs again.
    """
    return with_ordinal(in_ranges(df, [*keys, *order]), keys, F.col(BLK), order, name)


def with_last_seen(df, keys, block, order, value, name) -> DataFrame:
    """Last non-null `value` at or before each row."""
    d = df.withColumn(BLK, block).withColumn("_val", col(value))
    at = F.when(F.col("_val").isNotNull(), F.struct(*order))
    ends = d.groupBy(*keys, BLK).agg(F.max_by("_val", at).alias("_end"))
    carry = ends.select(*keys, BLK, F.last("_end", ignorenulls=True).over(_before(keys)).alias("_carry"))
    w = Window.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn("_here", F.last("_val", ignorenulls=True).over(w)).join(carry, [*keys, BLK])
    return out.withColumn(name, F.coalesce("_here", "_carry")).drop("_val", "_here", "_carry", BLK)


def with_lag(df, keys, block, order, value, name) -> DataFrame:
    """Previous row's `value` per key."""
    d = df.withColumn(BLK, block).withColumn("_val", col(value))
    ends = d.groupBy(*keys, BLK).agg(F.max_by("_val", F.struct(*order)).alias("_end"))
    carry = ends.select(*keys, BLK, F.last("_end").over(_before(keys)).alias("_carry"))
    w = Window.partitionBy(*keys, BLK).orderBy(*order)
    out = (
        d.withColumn("_n", F.row_number().over(w)).withColumn("_here", F.lag("_val").over(w)).join(carry, [*keys, BLK])
    )
    return out.withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_here"))).drop(
        "_val", "_n", "_here", "_carry", BLK
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct (key, value): its count and the rows below it.

    `n` rows hold the value, `below` rows hold a smaller one and `total` is the
    key's size; `extra` adds summed columns (name -> per-row number) with the
    same `<name>`, `<name>_below`, `<name>_total`. Counting collapses ties before
    any ordering, so a value shared by many rows costs one row. The counts are
    materialised once, in ranges; both passes over blocks read those.
    """
    extra = extra or {}
    sums = {"n": F.lit(1), **extra}
    d = in_ranges(df.groupBy(*keys, value).agg(*[F.sum(e).alias(k) for k, e in sums.items()]), [*keys, value])
    blocks = d.groupBy(*keys, BLK).agg(*[F.sum(k).alias(f"_s_{k}") for k in sums])
    whole = Window.partitionBy(*keys)
    carry = blocks.select(
        *keys,
        BLK,
        *[F.coalesce(F.sum(f"_s_{k}").over(_before(keys)), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(whole).alias(f"_t_{k}") for k in sums],
    )
    w = Window.partitionBy(*keys, BLK).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = d.select("*", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_b_{k}") for k in sums])
    out = out.join(carry, [*keys, BLK])
    names = {k: ("below" if k == "n" else f"{k}_below", "total" if k == "n" else f"{k}_total") for k in sums}
    return out.select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_b_{k}") + F.col(f"_c_{k}")).alias(names[k][0]) for k in sums],
        *[F.col(f"_t_{k}").alias(names[k][1]) for k in sums],
    )
