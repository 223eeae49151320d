"""Whole runs: places and settings travel with the chunks, windows are packed where they are read, and verification misses nothing."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boundwell import cli
from boundwell.config import Config
from boundwell.operators import blocks as B
from boundwell.operators import cluster, kmeans, packing, residual, stream
from boundwell.operators.encode import encode_window, plane_width
from boundwell.plans import compress as plans
from boundwell.plans import report
from boundwell.sources import container, tensors
from boundwell.streaming.micro_batch import compress_stream
from tests.test_engine import TRICKY, VPW, as_stream, back, relative, same_bits, weights

CFG = Config(1e-3, window_bytes=VPW * 4)


def placed(spark, pos, x):
    return spark.createDataFrame(pd.DataFrame({"pos": pos, "x": np.asarray(x, np.float32)}), "pos long, x float")


def pairs_of(df):
    return {r.pos: r.x for r in df.collect()}


@pytest.mark.parametrize("mode", ["cluster", "residual", "vq"])
def test_places_survive(spark, mode):
    rng = np.random.default_rng(1)
    pos = np.sort(rng.choice(50_000, 3000, replace=False))
    x = weights(3000, 2)
    cfg = Config(1e-3, "relative" if mode == "cluster" else "absolute", mode, VPW * 4, k_start=4, max_k=4 if mode != "cluster" else 1 << 24, kmeans_iters=2)
    rows = placed(spark, pos, x).unionByName(spark.createDataFrame([(60_000, None)], "pos long, x float"))
    chunks = plans.compress(rows.repartition(5), cfg)
    got = pairs_of(plans.decompress(chunks))
    assert sorted(got) == pos.tolist()
    assert mode == "vq" or all(abs(got[p] - v) <= 1e-3 * (abs(v) if mode == "cluster" else 1) * (1 + 1e-6) for p, v in zip(pos.tolist(), x.tolist(), strict=True))
    row = plans.verify_chunks(rows.where("x is not null"), chunks).first()
    assert row.n_values == 3000 and row.unmatched == 0 and row.passed == (mode != "vq")


def test_a_container_keeps_places_and_settings(spark, tmp_path):
    pos = np.arange(0, 3000, 3)
    rows = placed(spark, pos, weights(1000, 3))
    path = str(tmp_path / "x.wp")
    container.write_container(plans.compress(rows, CFG), path, {"mode": "cluster"})
    chunks = container.read_container(spark, path)
    assert sorted(pairs_of(plans.decompress(chunks))) == pos.tolist()
    assert plans.verify_chunks(rows, chunks).first().passed
    footer = container.read_footer(path)
    assert (footer["window_size"], footer["error_bound"]) == (VPW * 4, 1e-3)
    whole = plans.compress(as_stream(spark, weights(2000, 3)), CFG)
    container.write_container(whole, path, {})
    assert not any("places_blob_len" in e for e in container.read_footer(path)["chunks"])


def test_verification_fails_on_what_doesnt_meet(spark):
    x = weights(5000, 4)
    rows, chunks = as_stream(spark, x), plans.compress(as_stream(spark, x), CFG).cache()
    assert plans.verify_chunks(rows, chunks).first().passed
    for s, c, lost in ((rows, chunks.where("w < 3"), 2000), (rows.where("pos % 10 <> 0"), chunks, 500), (rows.where("pos < 4500"), chunks, 500), (rows, chunks.limit(0), 5000)):
        row = plans.verify_chunks(s, c, CFG).first()
        assert (row.passed, row.unmatched, row.violations) == (False, lost, 0)
    moved = chunks.withColumn("w", F.col("w") + 1)
    assert not plans.verify_chunks(rows, moved).first().passed
    with pytest.raises(ValueError):
        plans.settings(chunks.unionByName(plans.compress(rows, Config(1e-3, window_bytes=400))))
    chunks.unpersist()


def test_the_command_line_goes_by_the_chunks(spark, tmp_path, capsys):
    np.save(tmp_path / "w.npy", weights(5000, 9))
    source, target = str(tmp_path / "w.npy"), str(tmp_path / "w.chunks")
    assert cli.main(["compress", source, target, "-e", "1e-3", "-w", "4KB"], spark) == 0
    said = capsys.readouterr().out
    assert "HELD" in said and "MiB/s" in said and said.count("window ") >= 5 and "label" in said
    assert cli.main(["verify", source, target, "--json"], spark) == 0
    row = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (row["n_values"], row["unmatched"], row["passed"]) == (5000, 0, True)
    assert cli.main(["decompress", target, str(tmp_path / "back.npy")], spark) == 0
    assert relative(weights(5000, 9), np.load(tmp_path / "back.npy")) <= 1e-3
    np.save(tmp_path / "short.npy", weights(5000, 9)[:4000])
    assert cli.main(["verify", str(tmp_path / "short.npy"), target], spark) == 1
    assert cli.main(["compress", source, str(tmp_path / "w.wp"), "--mode", "residual", "--k-start", "2", "--max-k", "2", "--json"], spark) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["held"] and abs(sum(told[k] for k in told if k.endswith("_share")) - 100) < 1e-6 and told["k_histogram"] == {"2^1": 1}


def test_batches_that_cut_windows_keep_places(spark, tmp_path):
    x = weights(2500, 10)
    for n, (a, b) in enumerate(((0, 700), (700, 1300), (1300, 2500))):
        as_stream(spark, x).where(f"pos >= {a} and pos < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema("pos long, x float").parquet(str(tmp_path / "in"))
        compress_stream(live, CFG, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    chunks = spark.read.schema(packing.CHUNK + ", batch int").parquet(str(tmp_path / "out")).drop("batch")
    assert chunks.count() == 5
    assert relative(x, back(plans.decompress(chunks), 2500)) <= 1e-3
    assert plans.verify_chunks(as_stream(spark, x), chunks).first().passed


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_values_are_not_shuffled(spark, tmp_path):
    x = weights(4000, 11)
    np.save(tmp_path / "w.npy", x)
    chunks = plans.compress_file(spark, str(tmp_path / "w.npy"), CFG)
    assert not exchanges(chunks) and chunks.rdd.getNumPartitions() == 4
    assert relative(x, back(plans.decompress(chunks), 4000)) <= 1e-3
    assert len(exchanges(plans.compress(as_stream(spark, x), CFG))) == 1
    sizes = [len(r.data) for r in B.blocks(as_stream(spark, x).coalesce(1), VPW).collect()]
    assert sizes == [4000] * 4


def test_blocks_refuse_two_values_at_a_place(spark):
    rows = placed(spark, [1, 2, 2], [1.0, 2.0, 3.0])
    with pytest.raises(Exception, match="several values"):
        plans.compress(rows, CFG).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(width=32, allow_subnormal=True), min_size=1, max_size=120), st.sampled_from([1e-2, 1e-5]))
def test_encoded_windows_hold_their_bound(values, bound):
    x = np.array(values, np.float32)
    for mode, domain in (("cluster", "relative"), ("residual", "relative"), ("residual", "absolute")):
        cfg = Config(bound, domain, mode, tuple_size=3, k_start=2, max_k=2 if mode == "residual" else 1 << 20, kmeans_iters=2)
        chunk = encode_window(0, np.arange(len(x)), x, cfg)
        y = packing.unpack_window(chunk)
        assert len(y) == len(x)
        if domain == "relative":
            assert relative(x, y) <= bound
        else:
            ok = np.isfinite(x)
            assert np.array_equal(x[~ok], y[~ok], equal_nan=True) and np.abs(x[ok].astype(float) - y[ok]).max(initial=0) <= bound


def test_the_window_encoder_agrees_with_the_expressions(spark):
    x = np.concatenate([weights(950, 12), TRICKY])
    rows = stream.windowed(as_stream(spark, x), VPW)
    enc = cluster.encode(rows, 1e-3).orderBy("i").toPandas()
    chunk = encode_window(0, np.arange(len(x)), x, CFG)
    assert chunk["k"] == enc["cell"].nunique() and chunk["n_outliers"] == int(enc["esc"].sum())
    y = packing.unpack_window(chunk)
    assert same_bits(y[~enc["esc"]], enc["xhat"][~enc["esc"]].to_numpy(np.float32))
    assert np.isclose(chunk["max_error"], enc["rel"].max()) and np.isclose(chunk["mean_error"], enc["rel"].mean())
    for domain, source in (("absolute", x), ("relative", x)):
        cfg = Config(1e-3, domain, "residual", tuple_size=1, k_start=1, max_k=1, kmeans_iters=3)
        chunk = encode_window(0, np.arange(len(source)), source, cfg)
        pred = float(np.frombuffer(chunk["centroids"], "<f4")[0])
        q = residual.quantize(rows.withColumn("pred", F.lit(pred).cast("float")), 1e-3, domain == "relative").orderBy("i").toPandas()
        assert chunk["n_outliers"] == int(q["esc"].sum()) and len(chunk["code_plane_blobs"]) <= int(q["width"].max())
        assert np.isclose(chunk["max_error"], q["err"].max())


def test_tuples_have_a_label_each(spark):
    x = weights(2001, 13)
    chunk = plans.compress(as_stream(spark, x), Config(1e-3, "absolute", "vq", 1 << 20, tuple_size=2, k_start=4, max_k=4, kmeans_iters=2)).first()
    book = np.frombuffer(chunk.centroids, "<f4")
    labels = packing.zstandard.ZstdDecompressor().decompress(chunk.labels_blob)
    assert (chunk.k, chunk.tuple_size, len(book), len(labels), len(chunk.code_plane_blobs)) == (4, 2, 8, 1001, 0)


def test_log_errors_of_the_search_are_told_as_relative():
    x = np.abs(weights(3000, 14)) + np.float32(1e-3)
    cfg = Config(1e-3, "relative", "residual", k_start=4, max_k=4, tuple_size=1, kmeans_iters=3)
    chunk = encode_window(0, np.arange(len(x)), x, cfg)
    book = np.frombuffer(chunk["centroids"], "<f4").astype(float)
    worst = np.abs(np.log(x.astype(float))[:, None] - book[None]).min(1).max()
    assert np.isclose(chunk["search_error"], np.expm1(worst), rtol=1e-4)


def test_plane_width_samples_the_windows_own_values(monkeypatch):
    import boundwell.operators.encode as E

    z = np.zeros(4096, np.uint32)
    z[1::2] = np.random.default_rng(0).integers(0, 1 << 16, 2048)
    assert plane_width(z) == 2
    monkeypatch.setattr(E, "PLANE_SAMPLE", 2048)
    assert plane_width(z) == 2  # overflow is counted over all values, whatever the sample sees


def test_progress_is_told_by_window(spark, tmp_path):
    seen = []
    plans.write_run(plans.compress(as_stream(spark, weights(3000, 15)), CFG), str(tmp_path / "run"), seen.append)
    assert [r.w for r in seen] == [0, 1, 2] and all(r.max_error <= 1e-3 and r.n_values == 1000 for r in seen)
    assert all(abs(r.codebook_share + r.label_share + r.code_share + r.outlier_share - 100) < 1e-9 for r in seen)


def test_folders_and_fortran_arrays(spark, tmp_path):
    x = weights(2600, 16)
    for kind in ("npy", "safetensors", "bin"):
        path = str(tmp_path / kind)
        told = tensors.write_files(as_stream(spark, x), path, 1000, kind).collect()
        assert sorted((r.file, r.n_values) for r in told) == [(f"part-0000000{i}.{kind}", n) for i, n in ((0, 1000), (1, 1000), (2, 600))]
        assert same_bits(back(tensors.read_stream(spark, path, "<f4"), 2600), x)
        found = {r.w: (r.first, len(r.data)) for r in tensors.read_windows(spark, path, 1300, "<f4").where("first = 0").collect()}
        assert sorted(found) == [0, 1]
        chunks = plans.compress_file(spark, path, Config(1e-6, "absolute", "residual", 5200, k_start=1, max_k=1), "<f4")
        assert np.abs(back(plans.decompress(chunks), 2600).astype(float) - x).max() <= 1e-6
    assert tensors.read_windows(spark, str(tmp_path / "npy"), 1300, limit_bytes=5600).select(F.sum(F.length("data"))).first()[0] == 5600
    cube = np.arange(24, dtype=np.float64).reshape(2, 3, 4)
    np.save(tmp_path / "f.npy", np.asfortranarray(cube))
    assert same_bits(back(tensors.read_stream(spark, str(tmp_path / "f.npy")), 24), np.arange(24, dtype=np.float32))


def test_restored_tensors_come_in_slices_with_their_shapes(spark, monkeypatch):
    monkeypatch.setattr(stream, "SLICE_VALUES", 16)
    x = weights(100, 17)
    manifest = spark.createDataFrame([("a", [7, 10], 0, 70), ("none", [0, 3], 70, 0), ("b", [30], 70, 30), ("late", [0], 100, 0), ("cut", [5], 98, 5)], "name string, shape array<long>, offset long, numel long")
    slices = stream.restore(as_stream(spark, x), manifest)
    assert slices.agg(F.max(F.size("values"))).first()[0] <= 16
    got = dict(stream.restored_arrays(slices))
    assert {n: a.shape for n, a in got.items()} == {"a": (7, 10), "none": (0, 3), "b": (30,)}
    assert same_bits(got["a"].ravel(), x[:70]) and same_bits(got["b"], x[70:])


def test_arrays_are_checked(spark):
    rows = spark.createDataFrame([(0, [1.0, None, 3.0]), (1, [4.0]), (None, [9.0]), (3, None)], "id long, v array<float>")
    assert pairs_of(stream.flat_arrays(rows, "id", "v", 3)) == {0: 1.0, 2: 3.0, 3: 4.0}
    with pytest.raises(Exception, match="more than 2 values"):
        stream.flat_arrays(rows, "id", "v", 2).collect()


def test_lossless_of_source_bytes(spark, tmp_path):
    raw = weights(5000, 18).astype("<f2").tobytes()
    (tmp_path / "h.bin").write_bytes(raw)
    row = packing.lossless_file(spark, str(tmp_path / "h.bin")).first()
    assert row.raw_bytes == 10_000 and 0 < row.plain_bytes <= 10_200 and 0 < row.planes_bytes
    assert packing.lossless_file(spark, str(tmp_path / "h.bin"), limit=4000, piece=1000).first().raw_bytes == 4000
    np.save(tmp_path / "x.npy", weights(100, 1))
    assert packing.lossless_file(spark, str(tmp_path / "x.npy")).first().raw_bytes == 400


def test_planned_experiments(spark, tmp_path):
    np.save(tmp_path / "w.npy", weights(3000, 19))
    plan = report.planned({"missing": str(tmp_path / "no.npy"), "w": str(tmp_path / "w.npy")}, ("models", "compare"), 4000, CFG)
    assert [(n, limit) for n, _, _, limit in plan] == [("model-w", None), ("method-cluster", 4000), ("method-residual", 4000), ("method-vq", 4000)]
    rows = [r.first() for r in report.run_planned(spark, plan[:2])]
    assert [(r.name, r.n_values, r.passed) for r in rows] == [("model-w", 3000, True), ("method-cluster", 1000, True)]
    assert report.planned({"missing": str(tmp_path / "no.npy")}) == []
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=8, max_size=8), st.integers(0, 3), st.sampled_from([0.0, 0.02, 0.5]))
def test_the_search_by_its_rules(costs, patience, gain):
    """Against a plain walk: the best so far is replaced by what undercuts it enough, and patience counts trials since."""
    cfg = Config(0.1, "absolute", "residual", k_start=2, max_k=64, k_patience=patience, min_k_gain=gain)
    ks = [1, 2, 4, 8, 16, 32, 64]
    best, at, tried = 0, 0, []
    for j, k in enumerate(ks):
        tried.append(k)
        if costs[j] < costs[best] * (1 - gain):
            best, at = j, j
        if j - at > patience:
            break
    found, trials = kmeans.search_k(lambda k: kmeans.Trial(k, costs[ks.index(k)], 1.0), 10**6, cfg)
    assert [t.k for t in trials] == tried and found.k == ks[best]
