"""Helpers for the tests of the training-data operators."""

import pytest


@pytest.fixture
def frame(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make
