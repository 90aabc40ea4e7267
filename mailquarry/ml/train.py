"""Classifiers: random forest, SVM, logistic regression, network, soft vote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.ml import svm
from mailquarry.ml.metrics import binary_metrics
from mailquarry.ml.prepare import SEED, feature_pipeline, spread

# The full search space; the default below is a part of it
FULL_FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20], "minInstancesPerNode": [1, 2, 4]}
SMALL_FOREST_GRID = {"numTrees": [20], "maxDepth": [5, 10]}
HIDDEN_LAYERS = [128, 64, 32, 16]
VOTERS = ["random_forest", "svm", "logistic"]


@dataclass
class Trained:
    """Fitted preprocessing and classifiers."""

    columns: list[str]
    prepare: PipelineModel
    models: dict[str, object] = field(default_factory=dict)


def _positive(df: DataFrame, model: str) -> DataFrame:
    return df.withColumn(model, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def train_forest(train: DataFrame, grid: dict | None = None, folds: int = 2):
    """Random forest by cross-validated F1."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", seed=SEED)
    builder = ParamGridBuilder()
    for name, values in (grid or SMALL_FOREST_GRID).items():
        builder = builder.addGrid(forest.getParam(name), values)
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=builder.build(), numFolds=folds, seed=SEED, parallelism=4,
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="f1"))
    return search.fit(train).bestModel


def train_svm(train: DataFrame, grid: dict | None = None, folds: int = svm.FOLDS) -> svm.SvmModel:
    """SVM with RBF or linear kernel by cross-validated F1 over C, gamma and kernel, and a curve that turns its margin into a probability."""
    return svm.train(train, grid, folds)


def train_logistic(train: DataFrame):
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000).fit(train)


def train_network(train: DataFrame, inputs: int, iterations: int = 60):
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=[inputs, *HIDDEN_LAYERS, 2], maxIter=iterations, seed=SEED).fit(train)


def train_all(rows: DataFrame, columns: list[str], grid: dict | None = None, folds: int = 2, names: list[str] | None = None) -> Trained:
    """Fit everything on rows with ``label``, ``part`` and the feature columns; only the classifiers ``names``, where given."""
    train = rows.filter("part = 'train'")
    prepare = feature_pipeline(columns).fit(train)
    n_rows = train.count()
    ready = spread(prepare.transform(train).select("features", "label"), n_rows).cache()
    fits = {
        "random_forest": lambda: train_forest(ready, grid, folds),
        "svm": lambda: train_svm(ready),
        "logistic": lambda: train_logistic(ready),
        "deep_learning": lambda: train_network(ready, len(columns)),
    }
    trained = Trained(columns, prepare, {name: fits[name]() for name in names or fits})
    ready.unpersist()
    return trained


def score(trained: Trained, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Wide probabilities per row: one column per model and the soft vote as ``ensemble``."""
    df = trained.prepare.transform(rows).select(*keep, "features")
    for name, model in trained.models.items():
        df = model.transform(df, name) if name == "svm" else _positive(model.transform(df), name)
    voters = [v for v in VOTERS if v in trained.models]
    if len(voters) > 1:
        df = df.withColumn("ensemble", sum((F.col(v) for v in voters), F.lit(0.0)) / len(voters))
    return df.drop("features")


def predictions(wide: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """Long form: (keep..., model_name, probability, prediction)."""
    return wide.unpivot(keep, models, "model_name", "probability").withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int"))


def evaluate(trained: Trained, rows: DataFrame, part: str = "test") -> DataFrame:
    """Metrics of every model on one part."""
    wide = score(trained, rows.filter(F.col("part") == part), ["label"])
    models = [c for c in wide.columns if c != "label"]
    return binary_metrics(predictions(wide, models, ["label"]))


def importances(trained: Trained, spark: SparkSession) -> DataFrame:
    """(feature, importance) of the forest; one row per feature column."""
    values = trained.models["random_forest"].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(trained.columns, values)], "feature string, importance double")


def save(trained: Trained, path: str) -> None:
    trained.prepare.write().overwrite().save(f"{path}/prepare")
    for name, model in trained.models.items():
        if name == "svm":
            model.save(f"{path}/{name}-0")
        else:
            model.write().overwrite().save(f"{path}/{name}-0")


def load(path: str, columns: list[str]) -> Trained:
    from pyspark.ml.classification import (
        LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel,
    )

    return Trained(columns, PipelineModel.load(f"{path}/prepare"), {
        "random_forest": RandomForestClassificationModel.load(f"{path}/random_forest-0"),
        "svm": svm.load(f"{path}/svm-0"),
        "logistic": LogisticRegressionModel.load(f"{path}/logistic-0"),
        "deep_learning": MultilayerPerceptronClassificationModel.load(f"{path}/deep_learning-0"),
    })


def embedding_classes(rows: DataFrame, classes: int = 4) -> DataFrame:
    """Class probabilities from precomputed embeddings (array) and a class label."""
    ready = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=50).fit(ready)
    scored = model.transform(ready).withColumn("p", vector_to_array("probability"))
    names = ["legitimate", "phishing", "scam", "suspicious"][:classes]
    return scored.select("vec_id", *[F.col("p")[i].alias(n) for i, n in enumerate(names)], F.array_max("p").alias("confidence"))


