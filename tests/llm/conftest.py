"""Fixtures of the training-data tests."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture()
def docs(spark):
    """docs([(id, text), ...]): a documents table with a few extra columns of clashing names."""

    def make(rows, parts=3):
        extra = "part string, block string, node string, chunk string, length string, _text2 string"
        data = [(i, t, "p", "b", "n", "c", "l", "t") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, " + extra).repartition(parts)

    return make
