"""Every registered query against its oracle SQL on the smallest data set."""

import pytest
from compare import difference, duck

import catalog

catalog.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, con, sf, key):
    diff, rows = difference(spark, con, key, catalog.QUERIES[key], catalog.ORACLES.get(key), sf)
    assert diff is None, diff
    assert rows >= 0


def test_every_key_has_an_oracle_or_is_learned():
    learned = {k for k in catalog.QUERIES if k.startswith("ml_")} | {"sink_model_history"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= learned
