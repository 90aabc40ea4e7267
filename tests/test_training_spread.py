"""Training rows are dealt over tasks by their number, whatever file or partition they come from."""

import importlib

from pyspark.sql import functions as F

import catalog
from mailquarry.ml import prepare

catalog.load_all()


def test_tasks_follow_the_number_of_rows(spark):
    rows = spark.range(100).coalesce(1)
    assert prepare.spread(rows, 100).rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    assert prepare.task_count(spark, 0) == 1
    assert prepare.task_count(spark, prepare.LEAST_TASK_ROWS * cores * 2) == cores
    assert prepare.task_count(spark, prepare.MOST_TASK_ROWS * cores * 2) == cores * 2


def test_training_rows_lie_in_many_files(spark, sf, monkeypatch):
    ml = importlib.import_module("catalog.ml")
    before = {tuple(r) for r in ml.training_rows(spark, sf).collect()}
    monkeypatch.setattr(prepare, "LEAST_TASK_ROWS", 10)
    rows = ml.training_rows(spark, sf)
    assert rows.select(F.input_file_name()).distinct().count() > 1
    assert {tuple(r) for r in rows.collect()} == before
