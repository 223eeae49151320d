"""The sample of a fit is taken of each window, as in the reference, so that a longer stream loses nothing."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boundwell.config import Config
from boundwell.operators import kmeans

FEW = Config(sample_per_k=1, sample_min=100, sample_max=100)


def tuples_of(spark, sizes):
    rng = np.random.default_rng(5)
    frame = pd.concat(pd.DataFrame({"w": w, "t": np.arange(n), "v0": rng.normal(w, 1, n), "v1": rng.normal(-w, 1, n)}) for w, n in enumerate(sizes))
    return spark.createDataFrame(frame, "w long, t long, v0 double, v1 double")


def test_query_agrees_with_its_sql_beyond_one_sample(spark, tmp_path):
    n = 9000  # vectors of 64 values: 288,000 pairs, where a sample of 64 clusters asks for 262,144
    values = np.random.default_rng(3).normal(0, 0.1, n * 64).astype(np.float32)
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.ListArray.from_arrays(np.arange(0, n * 64 + 1, 64, dtype=np.int32), values)})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    got = [tuple(r) for r in entry.queries()["tuple_sample"](spark, str(tmp_path)).collect()]
    assert got == con.execute(entry.oracle_sql()["tuple_sample"]).fetchall() and got[0][0] == n * 32


def test_a_fit_takes_all_tuples_of_windows_within_the_target(spark):
    rows = tuples_of(spark, [100] * 20)
    assert np.allclose(kmeans.fit(rows, 1, FEW), [rows.agg(F.avg("v0"), F.avg("v1")).first()], atol=1e-9)


def test_only_windows_beyond_the_target_are_sampled(spark):
    rows = tuples_of(spark, [100, 5000, 3, 101])
    some = kmeans.sample(rows, 4, FEW, ("w", "t"))
    assert some.columns == rows.columns and some.exceptAll(rows).isEmpty()
    held = {r["w"]: r["n"] for r in some.groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert held[0] == 100 and held[2] == 3 and 60 < held[1] < 150 and 90 < held[3] <= 101
    assert kmeans.sample(rows.where("w <> 1"), 4, FEW, ("w", "t")).where("w <> 3").exceptAll(some.where("w <> 3")).isEmpty()


def test_a_place_alone_is_one_window_and_no_rows_have_no_sample(spark):
    rows = tuples_of(spark, [5000]).drop("w")
    assert 60 < kmeans.sample(rows, 4, FEW, ("t",)).count() < 150
    assert kmeans.sample(rows.where("t < 100"), 4, FEW, ("t",)).count() == 100
    assert kmeans.fit(tuples_of(spark, [5]).where("false"), 4, FEW) == []
