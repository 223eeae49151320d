"""The queries over whole streams read every value, at any size of the tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from boundwell.queries import DIM

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_whole_streams(spark):
    table = lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")
    vectors, events = table("embeddings").count(), table("events").where("value is not null").count()
    assert entry.queries()["concat_whole"](spark, DIR).count() == vectors * DIM + events
    whole = entry.queries()["restore_whole"](spark, DIR)
    assert whole.count() == (vectors - 1) * DIM and whole.select("name").distinct().count() == vectors - 1
