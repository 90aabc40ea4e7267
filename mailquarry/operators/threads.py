"""Conversation context over ordered threads: conv_id, turn, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions.text import SPACE
from mailquarry.plans.skew import position_within

BLOCK = 1024
SEPARATOR = " [SEP] "


def numbered(threads: DataFrame) -> DataFrame:
    """Adds the 1-based position of each message in its thread, for turns with or without gaps."""
    return position_within(threads, ["conv_id"], F.floor(F.col("turn") / BLOCK), [F.asc("turn"), F.asc("text")])


def with_previous(threads: DataFrame, n: int) -> DataFrame:
    """Adds ``previous``: the texts of the ``n`` messages before each one, oldest first.

    A thread is cut into blocks of positions; the last ``n`` messages of a block are also given
    to the next one, so that a very long thread is spread over many tasks.
    """
    placed = numbered(threads).withColumn("_block", F.floor((F.col("position") - 1) / BLOCK))
    near_end = (F.col("position") - 1) % BLOCK >= BLOCK - n
    spread = placed.withColumn("_to", F.explode(F.when(
        near_end, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy("conv_id", "_to").orderBy("position").rowsBetween(-n, -1)
    return spread.withColumn("previous", F.collect_list("text").over(w)).filter(
        F.col("_to") == F.col("_block")).drop("_block", "_to")


def context(threads: DataFrame, n: int = 5) -> DataFrame:
    """Previous messages and the current one joined by the separator."""
    joined = F.array_join(F.concat("previous", F.array("text")), SEPARATOR)
    return with_previous(threads, n).select("conv_id", "turn", joined.alias("context"))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda t: t != ""))


def context_anomaly(threads: DataFrame, n: int = 2) -> DataFrame:
    """1 - 2 x token overlap with the previous messages, not below 0; 0 without history."""
    pairs = with_previous(threads, n).select(
        "conv_id", "turn", F.size("previous").alias("history"), _tokens(F.col("text")).alias("now"),
        _tokens(F.array_join("previous", " ")).alias("before"))
    overlap = F.try_divide(F.size(F.array_intersect("now", "before")), F.size(F.array_union("now", "before")))
    score = F.greatest(F.lit(0.0), 1 - overlap * 2)
    return pairs.select("conv_id", "turn", F.when(
        F.col("history") > 0, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)).alias("context_anomaly_score"))
