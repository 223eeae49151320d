from __future__ import annotations

import json

import numpy as np
import pandas as pd

from boundwell.config import Config
from boundwell.operators import packing, stream
from boundwell.plans import compress as plans
from boundwell.plans import report as R


def weights(spark, n=3000):
    x = np.random.default_rng(1).normal(0, 0.02, n).astype(np.float32)
    return x, spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "x": x}), "pos long, x float")


def test_experiments_and_report(spark, tmp_path):
    x, s = weights(spark)
    runs = {f"e{n}": Config(10.0**-n, window_bytes=4000) for n in (2, 4)}
    rows = R.experiments(s, runs, 6000)
    got = {r.name: r for r in rows.collect()}
    assert all(r.passed and r.windows == 3 and r.source_bytes == 6000 for r in got.values())
    assert got["e2"].stored_bytes < got["e4"].stored_bytes and got["e4"].max_error <= 1e-4
    R.write_results(rows, str(tmp_path / "results"))
    assert R.load_results(spark, str(tmp_path / "results")).count() == 2
    loss = packing.lossless(s).selectExpr("'e2' AS name", "*")
    joined = {r.name: r.lossless_ratio for r in R.with_lossless(rows, loss).collect()}
    assert joined["e2"] > 0.9 and joined["e4"] is None
    table = R.markdown([{"name": "a", "k": 64, "ratio": 1.23456}, {"name": "b"}], ["name", "k", "ratio"])
    assert table.splitlines()[2:] == ["| a | 2^6 | 1.235 |", "| b | - | - |"]
    once = R.splice("# T\n", "x", "one")
    assert R.splice(once, "x", "two") == once.replace("one", "two")


def test_load_skips_named_files(spark, tmp_path):
    for name in ("a", "summary", "lossless"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "v": 1}, indent=1))
    assert [r.name for r in R.load_results(spark, f"{tmp_path}/*.json").collect()] == ["a"]


def test_sweep_summary(spark):
    _, s = weights(spark)
    got = sorted(R.sweep_summary(stream.windowed(s, 1000), [1e-2, 1e-3]).collect(), key=lambda r: r.bound)
    assert [r.n_values for r in got] == [3000, 3000] and got[0].k > got[1].k and all(r.max_error <= r.bound for r in got)


def test_windows_come_one_by_one(spark):
    x, s = weights(spark)
    parts = list(R.iter_windows(plans.compress(s, Config(1e-3, window_bytes=4000))))
    assert [len(p) for p in parts] == [1000] * 3
    assert (np.abs(np.concatenate(parts) - x) <= 1e-3 * np.abs(x) * (1 + 1e-6)).all()


def test_memory_plan():
    assert [R.plan_concurrency(b, 10, 4) for b in (0, 9, 25, 1000)] == [1, 1, 2, 4]
    assert R.window_memory(1000, 64, 1) > 4000
