"""Fact tables as Parquet partitioned by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.session import shared_dir


def append(df: DataFrame, path: str, time_column: str | None = None) -> None:
    """Append rows; with a time column the table is partitioned by its date."""
    if time_column is None:
        df.write.mode("append").parquet(path)
        return
    write_days(df.withColumn("day", F.to_date(time_column)), path, "append")


def write_days(df: DataFrame, path: str, mode: str) -> None:
    """Write day partitions in files of the advisory size: small days are put together in one
    task and a large day is split over many."""
    (df.hint("rebalance", F.col("day")).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def new_table_path(spark, name: str) -> str:
    """A fresh folder for a table under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_and_read(df: DataFrame, name: str, time_column: str | None = None) -> DataFrame:
    """Write to a fresh table and return what reads back."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    append(df, path, time_column)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the written table.

    Cuts the lineage: later branches read the narrow table, and a lost executor repeats nothing.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
