"""Training rows: column alignment, imputation, scaling, encoding, stratified split."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.plans.skew import position_within

SEED = 42
#: Rows of a task in training: fewer are not worth a task of their own, more cost time and memory.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 20_000, 1_000_000
TEST_SHARE, VALIDATION_SHARE = 0.2, 0.1


def align(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The wanted feature columns in order; a missing column or value counts as 0."""
    return rows.select(*keep, *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(c)
        for c in columns])


def fit_scaling(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column after mean imputation; one aggregate row."""
    n = F.count(F.lit(1))
    row = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[
        # imputed rows add nothing to the squared deviations, only to the count
        F.sqrt(F.var_pop(c) * F.count(c) / n).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Impute by the mean and standardise."""
    return rows.withColumns({
        c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / (s or 1.0) for c, (m, s) in scaling.items()})


def fit_categories(rows: DataFrame, column: str, at_most: int = 10_000) -> list[str]:
    """Sorted distinct values of a category column; refuses columns that are not categories."""
    values = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(at_most + 1).collect()]
    if len(values) > at_most:
        raise ValueError(f"{column} has more than {at_most} values")
    return values


def encode(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Index of the value; unseen values share the index after the last."""
    known = F.array(*[F.lit(v) for v in values])
    position = F.array_position(known, F.col(column).cast("string"))
    return rows.withColumn(f"{column}_index", F.when(position > 0, position - 1).otherwise(F.lit(len(values))))


def split(rows: DataFrame, key: Column, label: str = "label", seed: int = SEED) -> DataFrame:
    """Adds ``part``: test, validation or train, in exact shares within each label.

    Rows are ordered by a hash of their key, so the split is the same on every run; positions
    are counted per hash range, so a large label is not numbered in one task.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))))
    placed = position_within(hashed, [label], F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"), [F.asc("_hash")])
    sizes = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    sized = placed.join(sizes, label)
    position, size = F.col("position"), F.col("_size")
    part = (F.when(position <= F.round(size * TEST_SHARE), "test")
            .when(position <= F.round(size * (TEST_SHARE + VALIDATION_SHARE)), "validation").otherwise("train"))
    return sized.withColumn("part", part).drop("_hash", "_size", "position")


def task_count(spark: SparkSession, n_rows: int) -> int:
    """Over how many tasks to spread rows that are read many times: the cores of the session, fewer for few rows, more for very many."""
    return max(min(-(-n_rows // LEAST_TASK_ROWS), spark.sparkContext.defaultParallelism), -(-n_rows // MOST_TASK_ROWS), 1)


def spread(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """The rows dealt evenly over :func:`task_count` tasks, by hash of ``keys`` where given. Feature rows are small, so that
    the tables they come from lie in one file or partition; without this, every pass of a classifier is one task."""
    count = task_count(rows.sparkSession, n_rows)
    return rows.repartition(count, *keys) if count > 1 else rows


def feature_pipeline(columns: list[str]) -> Pipeline:
    """Mean imputation, assembly and standardisation for the classifiers."""
    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ])


