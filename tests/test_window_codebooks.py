"""Residual and vq mode search k and fit centroids in each window, whatever the other windows hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from boundwell.config import Config
from boundwell.functions import scalar as S
from boundwell.operators import kmeans, sizes, stream
from boundwell.plans import compress as plans

VPW = 1000


@pytest.mark.parametrize("mode", ["vq", "residual"])
def test_windows_have_their_own_codebooks(spark, mode):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.02, VPW), rng.normal(0, 50, VPW)]).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(x)), "x": x}), "pos long, x float")
    cfg = Config(1e-3, "absolute", mode, VPW * 4, k_start=8, max_k=8, kmeans_iters=4)
    both = plans.compress(frame, cfg).orderBy("w").collect()
    alone = [plans.compress(frame.where(f"pos div {VPW} = {w}"), cfg).first() for w in (0, 1)]
    assert both == alone
    if mode == "vq":
        y = plans.decompress(plans.compress(frame, cfg), VPW).orderBy("pos").toPandas()["x"].to_numpy()
        assert np.abs(y - x)[:VPW].max() < 0.1


def test_a_windows_trial_is_the_streams(spark):
    x = np.random.default_rng(4).normal(0, 0.02, VPW).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(x)), "x": x}), "pos long, x float")
    wide = stream.tuples(stream.windowed(frame, VPW), 2)
    book = np.random.default_rng(5).normal(0, 0.02, (16, 2))
    cost = sizes.trial_cost(kmeans.assign(wide, book.tolist()), S.step_value(1e-3), 16, 2).first()
    rows = x.astype(float).reshape(-1, 2)
    trial = kmeans.window_trial(rows, book, kmeans.nearest(rows, book), 16, Config(1e-3, "absolute", "residual"))
    assert abs(trial.est_bytes - cost.est_bytes) <= 1
    assert np.allclose((trial.max_error, trial.mean_error), (cost.max_error, cost.mean_error))
