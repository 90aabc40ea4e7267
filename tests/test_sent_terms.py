"""Terms and rules searched where the texts are read, against the index of any size and against Python."""

import pytest
from pyspark.sql import functions as F

from mailquarry.operators import terms

TEXTS = ["", "a cat sat", "a cat sat", "cats and dogs and a much longer phrase of words", "dög", "phrase"]
STRINGS = [("r1", 2, 0, "cat"), ("r1", 2, 0, "dög"), ("r1", 2, 1, "sat"), ("r2", 1, 0, "much longer phrase"), ("r3", 2, 0, "cat"), ("r4", 1, 0, ""),
           ("r5", 2, 0, "cat"), ("r5", 2, 1, None)]


def tables(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("body", terms.body_key(F.col("text")))
    return texts, spark.createDataFrame(STRINGS, "rule string, n int, at int, term string")


@pytest.mark.parametrize("most", [0, 200_000])
def test_both_ways_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "MOST_SENT", most, raising=False)
    texts, strings = tables(spark)
    keys = {r.body: r.text for r in texts.collect()}
    got = [(keys[r.body], r.term) for r in terms.terms_in(texts, strings).collect()]
    assert sorted(got) == sorted({(t, w) for t in TEXTS for *_, w in STRINGS if w is not None and w in t})
    rules = sorted((keys[r.body], r.rule) for r in terms.rules_in(texts, strings).collect())
    assert rules == sorted([(t, "r4") for t in set(TEXTS)] + [("a cat sat", "r1"), (TEXTS[3], "r2")])
    none = terms.rules_in(texts, strings.limit(0))
    assert none.count() == 0 and terms.rules_in(texts.limit(0), strings).count() == 0


def test_no_gram_or_text_is_shuffled_for_a_small_index(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("grams of the texts are shuffled")

    monkeypatch.setattr(terms, "_gram_hits", refuse)
    texts, strings = tables(spark)
    assert terms.terms_in(texts, strings).count() > 0
    assert terms.rules_in(texts, strings).count() > 0
