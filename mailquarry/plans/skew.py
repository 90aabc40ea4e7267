"""Joins and numberings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """The table with a broadcast hint while it is counted small; as it is beyond that."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = 1_000_000) -> DataFrame:
    """The key values with at least ``min_rows`` rows, and over how many tasks to spread each."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows)
    return counted.select(*keys, F.ceil(F.col("_rows") / min_rows).cast("int").alias("_salts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Equi join in which rows of hot keys on the left go to as many tasks as their number asks for.

    Only the matching right rows of hot keys are repeated; all other keys join as usual.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_salts")).cast("int")
    salted = left.join(hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    copies = (
        right.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def position_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                    name: str = "position") -> DataFrame:
    """1-based position of each row within ``keys``, without putting one key in one task.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside (key, bucket); the
    counts of the earlier buckets, one row per (key, bucket), give the offset. Null keys are one key,
    and rows with a null bucket come first in theirs.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(inside)).alias("r")
    by = [*keys, "_bucket"]
    offsets = offsets.toDF(*[f"_of_{c}" for c in by], "_offset")
    same = functools.reduce(Column.__and__, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in by])
    return numbered.join(offsets, same).withColumn(name, F.col("_in") + F.col("_offset")).select(*df.columns, name)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                name: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark cuts to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
