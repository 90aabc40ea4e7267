"""Evaluation from (model_name, label, prediction, probability) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 10_000


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(predictions: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 per model."""
    positive, said = F.col("label") == 1, F.col("prediction") == 1
    counts = predictions.groupBy("model_name").agg(
        F.count_if(positive & said).alias("tp"), F.count_if(~positive & said).alias("fp"),
        F.count_if(positive & ~said).alias("fn"), F.count_if(~positive & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "model_name", "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Exact rank-based area per model, ties counted half.

    Counted per distinct probability, then summed inside probability ranges with the negatives of
    the lower ranges as offset; no task sees a whole model.
    """
    positive = F.col("label") == 1
    points = predictions.groupBy("model_name", "probability").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranged = points.withColumn("bucket", F.floor(F.col("probability") * BUCKETS))
    totals = ranged.groupBy("model_name", "bucket").agg(F.sum("neg").alias("bucket_neg"))
    below = Window.partitionBy("model_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("model_name", "bucket", F.coalesce(F.sum("bucket_neg").over(below), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("model_name", "bucket").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(offsets, ["model_name", "bucket"])
    wins = F.col("pos") * (F.col("offset") + F.col("lower") + F.col("neg") / 2)
    return placed.groupBy("model_name").agg(
        F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("roc_auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per model and class, with macro and weighted means."""
    # each row counts once for its true class and once for the predicted one
    cells = predictions.groupBy("model_name", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select("model_name", F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").cast("int").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("model_name", "s.*")
    per_class = sides.groupBy("model_name", "class").agg(
        F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    scored = per_class.select(
        "model_name", F.col("class").cast("string").alias("class"), "support", _ratio(F.col("hit"), F.col("said")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1_score"))
    names = ("precision", "recall", "f1_score")
    macro = scored.groupBy("model_name").agg(F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in names])
    weighted = scored.groupBy("model_name").agg(F.sum("support").alias("total"), *[
        _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names])
    columns = ["model_name", "class", "support", *names]
    return (
        scored.select(columns)
        .unionByName(macro.withColumn("class", F.lit("macro avg")).select(columns))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")).withColumnRenamed("total", "support").select(columns))
    )


def select_best(metrics: DataFrame) -> DataFrame:
    """The model with the highest F1, by name on a tie."""
    return metrics.agg(F.min_by("model_name", F.struct(-F.col("f1_score"), "model_name")).alias("model_name"),
                       F.max("f1_score").alias("f1_score"))


def registry_stats(models: DataFrame) -> DataFrame:
    """Versions, active versions and best figures per model name."""
    return models.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if("is_active").alias("active_versions"),
        F.avg("accuracy").alias("avg_accuracy"), F.max("f1_score").alias("best_f1"),
        F.max_by("version", F.struct("f1_score", "version")).alias("best_version"), F.max("training_date").alias("last_trained"))


def enough_rows(rows: DataFrame, least: int = 1000) -> DataFrame:
    """Whether there are enough rows to train; reads no more than needed."""
    return rows.limit(least).agg((F.count(F.lit(1)) >= least).alias("train"), F.count(F.lit(1)).alias("rows_seen"))
