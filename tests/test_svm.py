"""The SVM has both kernels, the whole search, exact solutions and a probability from unseen margins."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mailquarry.ml import svm, train
from mailquarry.ml.metrics import binary_metrics


def rings(n, seed=0):
    """Rows of two rings, one in the other: no line parts them."""
    draw = np.random.RandomState(seed)
    y = np.arange(n) % 2 == 0
    angle, radius = draw.uniform(0, 2 * np.pi, n), np.where(y, 1.0, 3.0) + draw.normal(0, 0.2, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), y


def noisy(n, seed=0):
    draw = np.random.RandomState(seed)
    x = draw.normal(size=(n, 4))
    return x, x[:, 0] + draw.normal(0, 1.0, n) > 0.5


def frame(spark, x, y):
    rows = spark.createDataFrame([(*map(float, v), int(c)) for v, c in zip(x, y)], ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", label int")
    return rows.withColumn("features", array_to_vector(F.array(*[f"x{i}" for i in range(x.shape[1])])))


def test_rings_are_told_apart(spark):
    x, y = rings(180)
    parts = F.expr("CASE WHEN i % 10 < 6 THEN 'train' WHEN i % 10 < 8 THEN 'validation' ELSE 'test' END")
    rows = spark.createDataFrame([(i // 2, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "i int, x0 double, x1 double, label int")
    trained = train.train_all(rows.withColumn("part", parts), ["x0", "x1"])
    wide = train.score(trained, rows.filter("i % 10 >= 8"), ["label"])
    got = binary_metrics(train.predictions(wide, ["svm"], ["label"])).first()
    assert got.tp + got.tn == got.tp + got.fp + got.fn + got.tn == 36
    assert wide.columns == ["label", "random_forest", "svm", "logistic", "deep_learning", "ensemble"]


def test_every_candidate_is_tried_in_five_folds(spark):
    x, y = svm.ordered(*noisy(60))
    sent = spark.sparkContext.broadcast((x, y, svm.stratified(y, 5)))
    got = svm.search(sent, spark, svm.GRID, svm.FOLDS)
    assert [of for _, of in got] == [
        (c, g, k) for c in (0.1, 1.0, 10.0, 100.0) for g in ("scale", "auto", 0.001, 0.01, 0.1, 1.0) for k in ("rbf", "linear")
        if k == "rbf" or g == "scale"]
    fold = svm.stratified(y, 5)
    for score, (c, g, k) in got:
        each = []
        for i in range(5):
            model = svm.fit(x[fold != i], y[fold != i], c, svm.width(x[fold != i], g), k)
            each.append(svm.f1(y[fold == i], model.margin(x[fold == i]) > 0))
        assert score == pytest.approx(np.mean(each))
    assert {int((fold == i).sum()) for i in range(5)} == {12}
    assert max(y[fold == i].sum() for i in range(5)) - min(y[fold == i].sum() for i in range(5)) <= 1


@pytest.mark.parametrize("name", ["rbf", "linear"])
@pytest.mark.parametrize("C", [0.1, 100.0])
@pytest.mark.parametrize("working", [16, 1000])
def test_solutions_are_optimal(monkeypatch, name, C, working):
    monkeypatch.setattr(svm, "WORKING_SET", working)
    monkeypatch.setattr(svm, "BLOCK_ROWS", 50)
    x, y = noisy(150)
    x, y = np.concatenate([x, x[:20]]), np.concatenate([y, ~y[:20]])  # the same row with either label
    sign = np.where(y, 1.0, -1.0)
    beta, bias = svm._decompose(x, sign, C, 0.3, name)
    k = svm.kernel(x, x, name, 0.3)
    hinge = lambda m: np.maximum(0.0, 1.0 - sign * m).sum()
    dual = np.abs(beta).sum() - beta @ k @ beta / 2
    assert abs(beta.sum()) < 1e-6 * C and (sign * beta >= 0).all() and (np.abs(beta) <= C).all()
    primal = beta @ k @ beta / 2 + C * hinge(k @ beta + bias)
    assert 0 <= primal - dual + 1e-6 <= 2e-3 * C * len(y)
    if name == "linear":
        model = svm.fit(x, y, C, 0.3, name)
        assert (model.support ** 2).sum() / 2 + C * hinge(model.margin(x)) == pytest.approx(dual, rel=1e-3)
    else:
        exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert np.allclose(svm.fit(x, y, C, 0.3, name).margin(x), exact @ beta + bias)


def test_order_and_partitions_do_not_matter(spark):
    x, y = noisy(80)
    grid = {"C": [1.0, 10.0], "gamma": ["scale", 1.0], "kernel": ["rbf", "linear"]}
    one = train.train_svm(frame(spark, x, y), grid)
    two = train.train_svm(frame(spark, x[::-1], y[::-1]).repartition(7), grid)
    assert (one.C, one.gamma, one.kernel) == (two.C, two.gamma, two.kernel)
    assert np.array_equal(one.probability(x), two.probability(x))


def test_saved_model_is_the_same(spark, tmp_path):
    x, y = noisy(60)
    for name in ("rbf", "linear"):
        model = train.train_svm(frame(spark, x, y), {"C": [1.0], "gamma": ["scale"], "kernel": [name]})
        model.save(str(tmp_path / name))
        again = svm.load(str(tmp_path / name))
        want = model.probability(x)
        assert np.allclose(again.probability(x), want, atol=1e-12) and ((want > 0) & (want < 1)).all()
        got = again.transform(frame(spark, x, y), "svm").select("svm").toPandas()["svm"]
        assert np.allclose(np.sort(got), np.sort(want), atol=1e-12)


def test_probability_follows_unseen_margins():
    margins = np.random.RandomState(1).normal(size=4000)
    y = np.random.RandomState(2).uniform(size=4000) < 1 / (1 + np.exp(-2 * margins + 1))
    slope, offset = svm.platt(margins, y)
    assert slope == pytest.approx(-2, abs=0.2) and offset == pytest.approx(1, abs=0.2)


def test_one_class(spark):
    x, _ = noisy(20)
    for label in (0, 1):
        model = train.train_svm(frame(spark, x, np.full(20, label)))
        got = [r[0] for r in model.transform(frame(spark, x, np.full(20, label)), "svm").select("svm").collect()]
        assert len(got) == 20 and all((p > 0.5) == label for p in got)
