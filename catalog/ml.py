"""Learning jobs: exact figures first, then training (compared by row count only)."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import view
from mailquarry.ml import metrics, prepare, train
from mailquarry.operators import content, ensemble, features
from mailquarry.session import shared_dir
from mailquarry.sinks.facts import append_and_read, staged

_P = "(SELECT *, (probability > 0.5e0)::INT AS prediction FROM v_predictions WHERE error IS NULL)"
_METRICS = f"""
    SELECT model_name, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 8) AS accuracy,
           round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0e0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0e0), 8) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0e0), 8) AS f1_score
    FROM (SELECT model_name, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
                 count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn FROM {_P} p GROUP BY model_name) c"""


def answered(spark, sf):
    return view(spark, sf, "v_predictions").filter("error IS NULL").withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int"))


@register("ml_metrics", _METRICS)
def ml_metrics(spark, sf):
    return plain(metrics.binary_metrics(answered(spark, sf)))


@register("ml_roc_auc", f"""
    SELECT model_name, round((sum(CASE WHEN label = 1 THEN r END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2e0)
           / nullif(count_if(label = 1) * count_if(label = 0), 0), 8) AS roc_auc, count_if(label = 1) AS positives, count_if(label = 0) AS negatives
    FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model_name, probability) - 1) / 2e0 AS r FROM {_P} p
          WINDOW w AS (PARTITION BY model_name ORDER BY probability)) x GROUP BY model_name""")
def ml_roc_auc(spark, sf):
    return plain(metrics.roc_auc(answered(spark, sf)))


_CLASSES = f"""
    SELECT model_name, c::VARCHAR AS class, count_if(label = c) AS support,
           coalesce(count_if(label = c AND prediction = c) / nullif(count_if(prediction = c), 0)::DOUBLE, 0e0) AS precision,
           coalesce(count_if(label = c AND prediction = c) / nullif(count_if(label = c), 0)::DOUBLE, 0e0) AS recall,
           coalesce(2 * count_if(label = c AND prediction = c) / nullif(count_if(label = c) + count_if(prediction = c), 0)::DOUBLE, 0e0) AS f1_score
    FROM {_P} p, (SELECT unnest([0, 1]) AS c) k GROUP BY model_name, c"""


@register("ml_class_report", f"""
    SELECT model_name, class, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1_score, 8) AS f1_score FROM ({_CLASSES}) a
    UNION ALL SELECT model_name, 'macro avg' AS class, sum(support)::BIGINT AS support, round(avg(precision), 8) AS precision, round(avg(recall), 8) AS recall,
           round(avg(f1_score), 8) AS f1_score FROM ({_CLASSES}) b GROUP BY model_name
    UNION ALL SELECT model_name, 'weighted avg' AS class, sum(support)::BIGINT AS support, round(sum(precision * support) / sum(support), 8) AS precision,
           round(sum(recall * support) / sum(support), 8) AS recall, round(sum(f1_score * support) / sum(support), 8) AS f1_score FROM ({_CLASSES}) c GROUP BY model_name""")
def ml_class_report(spark, sf):
    return plain(metrics.class_report(answered(spark, sf)))


@register("ml_select_best", f"SELECT model_name, f1_score FROM ({_METRICS}) m ORDER BY f1_score DESC, model_name LIMIT 1")
def ml_select_best(spark, sf):
    return plain(metrics.select_best(metrics.binary_metrics(answered(spark, sf))))


@register("ml_registry_stats", """
    SELECT model_name, count(*) AS versions, count_if(is_active) AS active_versions, round(avg(accuracy), 8) AS avg_accuracy, round(max(f1_score), 8) AS best_f1,
           max_by(version, (f1_score, version)) AS best_version, strftime(max(training_date), '%Y-%m-%d %H:%M:%S') AS last_trained FROM v_models GROUP BY model_name""")
def ml_registry_stats(spark, sf):
    return plain(metrics.registry_stats(view(spark, sf, "v_models")))


@register("ml_retrain_gate", "SELECT count(*) >= 1000 AS train, count(*) AS rows_seen FROM (SELECT doc_id FROM labels LIMIT 1000) x")
def ml_retrain_gate(spark, sf):
    return plain(metrics.enough_rows(view(spark, sf, "labels")))


_FRAME = "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN n_chars::DOUBLE END AS a, (doc_id % 7)::DOUBLE AS b, source FROM documents"


@register("ml_impute_scale", f"""
    SELECT doc_id, round((coalesce(a, ma) - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b,
           dense_rank() OVER (ORDER BY source) - 1 AS source_index
    FROM ({_FRAME}) f, (SELECT avg(a) AS ma, sqrt(var_pop(a) * count(a) / count(*)) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM ({_FRAME}) g) s""")
def ml_impute_scale(spark, sf):
    d = F.col("doc_id")
    frame = view(spark, sf, "documents").select(
        "doc_id", F.when(d % 10 != 0, F.col("n_chars").cast("double")).alias("a"), (d % 7).cast("double").alias("b"), "source")
    scaled = prepare.scale(frame, prepare.fit_scaling(frame, ["a", "b"]))
    return plain(prepare.encode(scaled, "source", prepare.fit_categories(frame, "source")).drop("source"), 6)


@register("ml_align_columns", """
    SELECT doc_id, 0e0 AS url_count, n_chars::DOUBLE AS text_length, 0e0 AS spf_pass, (CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE 0 END)::DOUBLE AS urgent_words_count
    FROM documents""")
def ml_align_columns(spark, sf):
    d = F.col("doc_id")
    rows = view(spark, sf, "documents").select(
        "doc_id", F.when(d % 3 > 0, d % 3).alias("urgent_words_count"), F.col("n_chars").alias("text_length"))
    return plain(prepare.align(rows, ["url_count", "text_length", "spf_pass", "urgent_words_count"], ["doc_id"]))


@register("ml_split", """
    SELECT doc_id, toxic::BIGINT AS label, CASE WHEN p <= round(n * 0.2e0) THEN 'test' WHEN p <= round(n * (0.2e0 + 0.1e0)) THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '-42')) AS p, count(*) OVER (PARTITION BY toxic) AS n FROM labels) x""")
def ml_split(spark, sf):
    rows = view(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return plain(prepare.split(rows, F.col("doc_id")).select("doc_id", "label", "part"))


_FEATURES: dict = {}


def mail_features(spark, sf):
    """Text features of every mail, written once per session and data set: training and scoring read them, and a body is searched once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURES:
        _FEATURES[key] = staged(content.content_features(view(spark, sf, "v_emails")), "mail-features")
    return _FEATURES[key]


def training_rows(spark, sf, mails=None):
    """Labelled feature rows, written once: the classifiers read them many times. ``mails`` are the mails' features, where at hand."""
    mails = content.content_features(view(spark, sf, "v_emails")) if mails is None else mails
    labels = view(spark, sf, "labels").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("message_id"), F.col("toxic").alias("label"))
    aligned = prepare.align(mails.join(labels, "message_id"), features.CONTENT, ["message_id", "label"])
    parted = prepare.split(aligned, F.col("message_id"))
    dealt = prepare.spread(parted, labels.count(), "message_id")
    # the forest draws by place: in the order of the split, however the rows came through the joins
    hashed = F.md5(F.concat_ws("-", "message_id", F.lit(str(prepare.SEED))))
    place = F.array_position(F.array(F.lit("test"), F.lit("validation"), F.lit("train")), F.col("part"))
    return staged(dealt.sortWithinPartitions("label", hashed, place), "training")


_FITTED: dict = {}


def fitted(spark, sf, *names):
    """Rows and models, trained once per session and data set for the jobs below. A job that shows one classifier names it
    and does not wait for the others, unless all are trained already."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _FITTED:
        return _FITTED[key]
    if (*key, *names) not in _FITTED:
        rows = training_rows(spark, sf, mail_features(spark, sf))
        only = {"names": [*names]} if names else {}
        _FITTED[(*key, *names)] = (rows, train.train_all(rows, features.CONTENT, **only))
    return _FITTED[(*key, *names)]


def _only(model):
    def query(spark, sf):
        rows, trained = fitted(spark, sf, *([] if model == "ensemble" else [model]))
        wide = train.score(trained, rows.filter("part = 'test'"), ["message_id", "label"])
        return plain(wide.select("message_id", "label", F.col(model).alias("probability")))
    return query


for _key, _model in [("ml_random_forest", "random_forest"), ("ml_svm", "svm"), ("ml_logistic", "logistic"),
                     ("ml_mlp", "deep_learning"), ("ml_vote", "ensemble")]:
    register(_key)(_only(_model))


@register("ml_embedding_softmax")
def ml_embedding_softmax(spark, sf):
    rows = view(spark, sf, "embeddings").withColumn("label", F.col("label") % 4)
    return plain(train.embedding_classes(rows))


@register("ml_evaluate_all")
def ml_evaluate_all(spark, sf):
    rows, trained = fitted(spark, sf)
    return plain(train.evaluate(trained, rows))


@register("ml_train_pipeline")
def ml_train_pipeline(spark, sf):
    rows = training_rows(spark, sf)
    trained = train.train_all(rows, features.CONTENT)
    train.save(trained, f"{shared_dir(spark)}/models-{uuid.uuid4().hex}")
    return plain(train.evaluate(trained, rows))


@register("ml_importance")
def ml_importance(spark, sf):
    _, trained = fitted(spark, sf, "random_forest")
    return plain(train.importances(trained, spark))


def scored_mails(trained, rows):
    wide = train.score(trained, rows, ["message_id"])
    models = [c for c in wide.columns if c not in ("message_id", "logistic")]
    return train.predictions(wide, models, ["message_id"])


@register("ml_batch_score")
def ml_batch_score(spark, sf):
    _, trained = fitted(spark, sf)
    mails = prepare.align(mail_features(spark, sf), features.CONTENT, ["message_id"])
    dealt = prepare.spread(mails, mails.count(), "message_id")
    long = scored_mails(trained, dealt).withColumn("error", F.lit(None).cast("string"))
    return plain(ensemble.soft_average(long))


@register("ml_save_load")
def ml_save_load(spark, sf):
    rows, trained = fitted(spark, sf)
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    train.save(trained, path)
    again = train.load(path, trained.columns)
    test = rows.filter("part = 'test'")
    one = train.score(trained, test, ["message_id"])
    two = train.score(again, test, ["message_id"])
    names = [c for c in one.columns if c != "message_id"]
    renamed = two.select("message_id", *[F.col(c).alias(f"{c}_loaded") for c in names])
    joined = one.join(renamed, "message_id")
    return joined.select("message_id", *[
        (F.abs(F.col(c) - F.col(f"{c}_loaded")) < 1e-9).alias(c) for c in names])


@register("sink_model_history")
def sink_model_history(spark, sf):
    rows, trained = fitted(spark, sf)
    history = train.evaluate(trained, rows).select(
        "model_name", "accuracy", "precision", "recall", "f1_score", F.lit("v1").alias("model_version"), F.lit(True).alias("is_active"))
    return plain(append_and_read(history, "model_training_history"))
