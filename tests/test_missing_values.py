"""Null, late and repeated input that earlier lost rows or failed."""

from pyspark.sql import functions as F

from mailquarry.operators import access, respond
from mailquarry.plans import skew
from mailquarry.sinks import maintenance


def test_lookup_without_time_and_late_lookup_come_back(spark):
    rows = [("a", "k", 9000), ("b", "k", 10001), ("c", "k", None), ("d", "q", 5)]
    lookups = spark.createDataFrame(rows, "lookup_id string, key string, s long").select("lookup_id", "key", F.timestamp_seconds("s").alias("ts"))
    carry = spark.createDataFrame([("k", 10000)], "key string, start long")
    got = {r.lookup_id: (r.start, r.refreshed) for r in access.lookup_cache(lookups, 3600, carry).collect()}
    assert got == {"a": (10000, False), "b": (10000, False), "c": (None, None), "d": (5, True)}


def test_null_subject_keeps_the_domain(spark):
    mails = spark.createDataFrame([("m", "x@evil.example", None)], "message_id string, sender string, subject string")
    links = spark.createDataFrame([], "message_id string, url string")
    assert [r.indicator for r in respond.indicators(mails, links).collect()] == ["sender_domain:evil.example"]


def test_position_keeps_null_keys_and_buckets(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 3)], "k string, t int")
    got = skew.position_within(rows, ["k"], F.col("t"), [F.asc("t")]).collect()
    assert sorted((str(r.k), str(r.t), r.position) for r in got) == [("None", "1", 1), ("None", "2", 2), ("a", "3", 2), ("a", "None", 1)]


def test_retention_keeps_rows_without_time_or_flag(spark):
    rows = spark.createDataFrame(
        [(1, "2020-01-01", None), (2, None, False), (3, "2020-01-01", False), (4, "2020-01-01", True), (5, "2030-01-01", False)],
        "id int, t string, is_quarantined boolean").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.id for r in maintenance.retain(rows, "2024-01-01 00:00:00").collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in maintenance.retain_metrics(rows, "2024-01-01 00:00:00").collect()) == [2, 5]
