"""The language model holds every n-gram, however many others there are."""

from pyspark.sql import functions as F

from mailquarry.llm import language


def test_rare_language_beside_many_ngrams(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"
    gram = F.concat(*[F.substring(F.lit(letters), (F.floor(F.col("id") / 40**k) % 40 + 1).cast("int"), F.lit(1)) for k in range(4)])
    many = spark.range(2_000_010).select(F.lit("aa").alias("lang"), gram.alias("gram"), F.lit(2).cast("long").alias("n"))
    rare = spark.createDataFrame([("zz", "éêèë", 1), ("zz", "êèëé", 1)], "lang string, gram string, n long")
    monkeypatch.setattr(language, "ngram_counts", lambda learning: many.unionAll(rare))
    model = language.fitted(None)
    assert model.languages == ["aa", "zz"] and len(model.keys[-1]) == 2_000_012
