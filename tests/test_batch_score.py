"""The batch score searches the mails' bodies once for training and scoring, with the same features as a search of its own."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.classification import RandomForestClassifier

from catalog import ml
from catalog.registry import plain
from datasets.views import view
from mailquarry.ml import prepare, train
from mailquarry.operators import content, ensemble, features

SMOKE = "/root/testdata/sf0.001"


def small_models(rows, columns):
    ready = prepare.feature_pipeline(columns).fit(rows)
    forest = RandomForestClassifier(labelCol="label", numTrees=2, maxDepth=2, seed=1).fit(ready.transform(rows))
    return train.Trained(columns, ready, {"random_forest": forest})


def test_bodies_are_searched_once(spark, monkeypatch, tmp_path):
    sf = str(tmp_path / "sf")
    shutil.copytree(SMOKE, sf)
    texts = ["Act now, verify your account!", None, "", "A long MEETING about the budget. " * 30]
    docs = pq.read_table(f"{SMOKE}/documents.parquet").schema
    rows = [{"doc_id": i // 2 if i < 20 else i, "text": texts[i % 4], "lang": "en", "source": "web"} for i in range(120)]  # some ids twice
    (tmp_path / "sf" / "documents.parquet").chmod(0o644)
    pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in docs.names} for r in rows], schema=docs), f"{sf}/documents.parquet")
    searched, search = [], content.content_features
    monkeypatch.setattr(ml, "_FITTED", {})
    monkeypatch.setattr(ml, "_FEATURES", {}, raising=False)
    monkeypatch.setattr(train, "train_all", small_models)
    monkeypatch.setattr(content, "content_features", lambda emails: searched.append(1) or search(emails))
    got = ml.ml_batch_score(spark, sf)
    assert len(searched) == 1
    _, trained = ml.fitted(spark, sf)
    mails = prepare.align(search(view(spark, sf, "v_emails")), features.CONTENT, ["message_id"])
    long = ml.scored_mails(trained, mails).selectExpr("*", "CAST(NULL AS STRING) AS error")
    want = plain(ensemble.soft_average(long))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 110
    keys = ["label", "message_id", "part"]
    shared = ml.training_rows(spark, sf, ml.mail_features(spark, sf)).select(keys).collect()
    assert shared == ml.training_rows(spark, sf).select(keys).collect()
