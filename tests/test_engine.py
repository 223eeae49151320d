"""The quantizer's invariants: every value decodes within the bound or is stored verbatim."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boundwell import cli
from boundwell.config import CODE_MAX, Config, human, parse_size, power_label
from boundwell.functions import scalar as S
from boundwell.operators import cluster, kmeans, packing, residual, sizes, stream, verify
from boundwell.plans import compress as plans
from boundwell.sources import container, tensors
from boundwell.streaming.micro_batch import compress_stream

VPW = 1000


def weights(n=5000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.02, n).astype(np.float32)
    x[rng.integers(0, n, max(1, n // 1000))] *= 500
    return x


TRICKY = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1e9, -1e9, 1e-42, 3.4e38, 0.5, -0.5, 1 + 1e-4], np.float32)


def as_stream(spark, x):
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(x)), "x": np.asarray(x, np.float32)}), "pos long, x float")


def windows(spark, x, vpw=VPW):
    return stream.windowed(as_stream(spark, x), vpw)


def back(df, n):
    out = np.full(n, np.nan, np.float32)
    rows = df.toPandas()
    out[rows["pos"]] = rows["x"]
    assert len(rows) == n
    return out


def same_bits(a, b):
    return np.array_equal(a.view(np.uint32) & 0x7FFFFFFF if np.isnan(a).any() else a.view(np.uint32), b.view(np.uint32) & 0x7FFFFFFF if np.isnan(b).any() else b.view(np.uint32))


def relative(x, y):
    x, y = x.astype(float), y.astype(float)
    ok = np.isfinite(x)
    assert np.array_equal(x[~ok], y[~ok], equal_nan=True)
    assert (y[x == 0] == 0).all()
    return float((np.abs(y[ok] - x[ok]) / np.maximum(np.abs(x[ok]), 1e-300)).max(initial=0))


@pytest.mark.parametrize(("mode", "error_mode", "bound"), [("cluster", "relative", 1e-2), ("cluster", "relative", 1e-5), ("residual", "relative", 1e-3), ("residual", "absolute", 1e-4)])
def test_round_trip_keeps_the_bound(spark, mode, error_mode, bound):
    x = np.concatenate([weights(2500, 1), TRICKY, weights(600, 2)])
    cfg = Config(bound, error_mode, mode, VPW * 4, k_start=4, max_k=8 if mode == "residual" else 1 << 24, kmeans_iters=2)
    chunks = plans.compress(as_stream(spark, x), cfg).cache()
    y = back(plans.decompress(chunks, VPW), len(x))
    if error_mode == "relative":
        assert relative(x, y) <= bound
    else:
        ok = np.isfinite(x)
        assert np.array_equal(x[~ok], y[~ok], equal_nan=True)
        assert np.abs(x[ok].astype(float) - y[ok]).max() <= bound
    row = plans.verify_chunks(as_stream(spark, x), chunks, cfg).first()
    assert row.passed and row.n_values == len(x) and row.n_windows == 4 and row.max_error <= bound
    total = sizes.run_stats(plans.stats(chunks)).first()
    assert total.n_values == len(x) and total.windows == 4 and total.stored_bytes > 0
    chunks.unpersist()


@pytest.mark.parametrize("x", [np.zeros(10, np.float32), np.full(10, np.nan, np.float32), np.full(10, 3.0, np.float32), np.array([7.0], np.float32), TRICKY])
def test_degenerate_windows(spark, x):
    cfg = Config(1e-4, window_bytes=VPW * 4)
    y = back(plans.decompress(plans.compress(as_stream(spark, x), cfg), VPW), len(x))
    assert relative(x, y) <= 1e-4
    params = cluster.window_params(windows(spark, np.zeros(10)), 1e-4).first()
    assert (params.umin, params.umax, params.k) == (0.0, 0.0, 64)


def test_empty_stream(spark):
    cfg = Config(1e-4, window_bytes=VPW * 4)
    assert plans.compress(as_stream(spark, weights(10)).limit(0), cfg).count() == 0


def test_k_doubles_until_cells_are_narrow(spark):
    rows = windows(spark, weights(), 5000)
    ks = [cluster.window_params(rows, b).first().k for b in (1e-1, 1e-2, 1e-3, 1e-4)]
    assert ks == sorted(ks) and len(set(ks)) > 2 and all(k >= 64 and k & (k - 1) == 0 for k in ks)
    assert cluster.window_params(rows, 1e-6, max_k=256).first().k == 256
    assert [cluster.first_k(k) for k in (1, 64, 65, 1000)] == [64, 64, 128, 1024]


def test_scaling_changes_nothing_but_the_centres(spark):
    x = weights(3000, 3)
    a, b = (cluster.window_stats(cluster.encode(windows(spark, v), 1e-4)).agg(F.sum("occupied")).first()[0] for v in (x, x * np.float32(1e6)))
    assert abs(a - b) <= 0.02 * a


def test_windows_and_limits(spark):
    counts = windows(spark, np.arange(2500), 1000).groupBy("w").count().orderBy("w").collect()
    assert [r["count"] for r in counts] == [1000, 1000, 500]
    assert stream.limit_values(as_stream(spark, np.arange(5000)), 4000).count() == 1000
    assert stream.limit_values(as_stream(spark, np.arange(5)), 1).count() == 1


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_tuples_are_padded_with_the_last_value(spark, size):
    x = np.arange(11, dtype=np.float32)
    got = stream.tuples(windows(spark, x, 7), size).orderBy("w", "t").collect()
    want = []
    for w in (x[:7], x[7:]):
        padded = np.concatenate([w, np.full(-len(w) % size, w[-1])])
        want += padded.reshape(-1, size).tolist()
    assert [list(r[2:]) for r in got] == want


def test_scalar_codecs(spark):
    values = [0, 1, -1, 2, -2, CODE_MAX, -CODE_MAX]
    df = spark.createDataFrame([(v,) for v in values], "c int").withColumn("z", S.zigzag(F.col("c")))
    got = df.select("c", "z", S.unzigzag(F.col("z")).alias("b"), S.join_planes(S.split_planes(F.col("z"))).alias("j")).collect()
    assert [r.b for r in got] == values and all(r.j == r.z == (2 * r.c if r.c >= 0 else -2 * r.c - 1) for r in got)
    tops = [(0, 1), (255, 1), (256, 2), (65535, 2), (65536, 3), (1 << 24, 4), (1 << 31, 4)]
    assert [r[0] for r in spark.createDataFrame(tops, "z long, p int").select(S.planes_needed(F.col("z"))).collect()] == [p for _, p in tops]
    ks = [(64, 1), (256, 1), (257, 2), (65536, 2), (65537, 4)]
    assert [r[0] for r in spark.createDataFrame(ks, "k long, b int").select(S.label_bytes(F.col("k"))).collect()] == [b for _, b in ks]
    half = spark.createDataFrame([(2.5,), (-2.5,), (float("nan"),), (1e30,)], "v double").select(S.residual_code(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("c"))
    assert [r.c for r in half.collect()] == [3, -2, 0, 0]


def test_residual_escapes(spark):
    x = np.array([0.0, 1e9, -1e9, 0.5], np.float32)
    rows = windows(spark, x).withColumn("pred", F.lit(0.0).cast("float"))
    q = residual.quantize(rows, 1e-6)
    assert sorted(r.i for r in q.where("esc").collect()) == [1, 2]
    y = residual.dequantize(q, q.where("esc").select("w", "i", "x")).orderBy("i").toPandas()["x"].to_numpy()
    assert y[1] == x[1] and y[2] == x[2] and abs(y[3] - 0.5) <= 1e-6


def test_escape_places_come_back_from_distances(spark):
    v = spark.createDataFrame([(0, 3, 0.0), (0, 10, 0.0), (1, 0, 0.0), (1, 7, 0.0)], "w long, i long, x float")
    got = residual.escape_places(residual.escape_deltas(v)).collect()
    assert all(r.place == r.i for r in got)


def test_step_guard():
    assert S.step_value(1e-4) == 2 * (1e-4 - 1e-8)
    assert S.step_value(1e-4, 1e9) == 2 * (1e-4 - 0.05e-4)


def test_search_k_control():
    cost = {1: 100, 4: 90, 8: 89.5, 16: 89, 32: 88.9, 64: 10}
    run = lambda k: kmeans.Trial(k, cost[k], 1 / k)
    cfg = Config(0.02, "absolute", "residual", k_start=7, max_k=64, k_patience=1)
    best, trials = kmeans.search_k(run, 10_000, cfg)
    assert best.k == 4 and [t.k for t in trials] == [1, 4, 8, 16]
    best, trials = kmeans.search_k(run, 10_000, Config(0.1, "absolute", "residual", k_start=4, max_k=64, k_criterion="vq"))
    assert best.k == 16 and [t.k for t in trials] == [4, 8, 16]
    assert [t.k for t in kmeans.search_k(run, 10_000, Config(0.1, "absolute", "residual", k_start=8, max_k=8))[1]] == [8]
    assert [t.k for t in kmeans.search_k(run, 8, Config(0.1, "absolute", "residual", k_start=4, max_k=64))[1]] == [1, 4, 8]


def test_assignments_agree_and_empty_clusters_are_reseeded(spark):
    rows = stream.tuples(windows(spark, weights(2000, 4), 2000), 2)
    book = [(float(a), float(b)) for a, b in np.random.default_rng(1).normal(0, 0.02, (100, 2))]
    far = kmeans.assign(rows, book).select("t", "label", "dist").orderBy("t").toPandas()
    near = kmeans.assign(rows, book[:64]).select("t", "label", "dist").orderBy("t").toPandas()
    x = rows.orderBy("t").toPandas()[["v0", "v1"]].to_numpy(float)
    for got, c in ((far, np.array(book)), (near, np.array(book[:64]))):
        d = ((x[:, None, :] - c[None]) ** 2).sum(-1)
        assert np.allclose(got["dist"], d.min(1), atol=1e-12) and np.allclose(d[np.arange(len(d)), got["label"]], d.min(1), atol=1e-12)
    moved, empty = kmeans.lloyd_step(rows, [(0.0, 0.0), (50.0, 50.0), (60.0, 60.0)], ("w", "t"))
    assert empty == 2 and all(np.abs(c).max() < 50 for c in moved)
    fitted = kmeans.fit(rows, 8, Config(kmeans_iters=10))
    assert len(fitted) == 8 and kmeans.assign(rows, fitted).agg(F.avg("dist")).first()[0] < kmeans.assign(rows, [(0.0, 0.0)]).agg(F.avg("dist")).first()[0]


def test_vq_is_small_and_lossy(spark):
    x = weights(2000, 5)
    cfg = Config(1e-4, "absolute", "vq", VPW * 4, k_start=4, max_k=4, kmeans_iters=3)
    chunks = plans.compress(as_stream(spark, x), cfg)
    assert chunks.agg(F.max("n_outliers")).first()[0] == 0
    assert not plans.verify_chunks(as_stream(spark, x), chunks, cfg).first().passed


def test_entropy(spark):
    df = spark.createDataFrame([(0, v) for v in (1, 1, 2, 2)] + [(1, 5)], "w long, v int")
    assert [(r.w, r.bits) for r in sizes.entropy_by(df, "v", "w").orderBy("w").collect()] == [(0, 1.0), (1, 0.0)]


def test_verify_sees_strange_values(spark):
    x = np.array([1.0, np.nan, np.inf, 0.0], np.float32)
    y = np.array([1.0, 1.0, np.inf, 0.0], np.float32)
    row = verify.verdict(verify.compare(windows(spark, x), windows(spark, y)), 1e-4).first()
    assert (row.violations, row.passed) == (1, False)


def test_config():
    assert parse_size("128MB") == 128 << 20 and parse_size("1.5 KiB") == 1536 and parse_size("7") == 7
    assert human(1536) == "1.50 KiB" and power_label(1 << 17) == "2^17" and power_label(3) == "3"
    for bad in ("", "x", "12 parsecs"):
        with pytest.raises(ValueError):
            parse_size(bad)
    for wrong in ({"mode": "other"}, {"error_bound": 0.0}, {"mode": "cluster", "error_mode": "absolute"}, {"tuple_size": 0}):
        with pytest.raises(ValueError):
            Config(**wrong)


def save_safetensors(path, tensors_):
    """tensors_: name -> (dtype tag, shape, bytes)."""
    header, at, data = {"__metadata__": {"a": "b"}}, 0, b""
    for name, (tag, shape, raw) in tensors_.items():
        header[name] = {"dtype": tag, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        data += raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


def test_safetensors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tensors, "SLICE", 64)
    f32, f16 = weights(100, 6), np.arange(7, dtype=np.float16)
    bf = np.array([1.5, -2.0, 3.25], np.float32)
    path = tmp_path / "m.safetensors"
    save_safetensors(path, {"odd": ("U8", [3], bytes([1, 2, 3])), "a": ("F32", [10, 10], f32.tobytes()), "h": ("F16", [7], f16.tobytes()), "b": ("BF16", [3], (bf.view(np.uint32) >> 16).astype("<u2").tobytes()), "t": ("BOOL", [2], b"\x01\x00"), "none": ("F32", [0], b""), "i": ("I64", [2], np.array([5, -6]).tobytes())})
    x = back(tensors.read_stream(spark, str(path)), 117)
    assert same_bits(x, np.concatenate([[1, 2, 3], f32, f16, bf, [1, 0], [5, -6]]).astype(np.float32))
    rows = tensors.manifest(spark, str(path)).collect()
    assert [(r.name, r.offset, r.numel) for r in rows if r.numel] == [("odd", 0, 3), ("a", 3, 100), ("h", 103, 7), ("b", 110, 3), ("t", 113, 2), ("i", 115, 2)]
    assert tensors.read_stream(spark, str(path), limit_bytes=40).count() == 10
    whole = stream.restore(tensors.read_stream(spark, str(path)).where("pos < 112"), tensors.manifest(spark, str(path))).collect()
    assert sorted(r.name for r in whole) == ["a", "h", "odd"] and [list(r.shape) for r in whole if r.name == "a"] == [[10, 10]]
    save_safetensors(path, {"x": ("F8_E4M3", [1], b"\0")})
    with pytest.raises(ValueError):
        tensors.manifest_of(str(path))


def test_npy_and_raw(spark, tmp_path):
    x = weights(3000, 7)
    np.save(tmp_path / "a.npy", x.astype(np.float64).reshape(30, 100))
    assert same_bits(back(tensors.read_stream(spark, str(tmp_path / "a.npy")), 3000), x)
    (tmp_path / "a.bin").write_bytes(x.astype("<f2").tobytes() + b"\x01")
    assert tensors.read_stream(spark, str(tmp_path / "a.bin"), "float16").count() == 3000
    assert tensors.write_npy(as_stream(spark, x[:50]), str(tmp_path / "out.npy")) == 50
    assert same_bits(np.load(tmp_path / "out.npy"), x[:50])
    assert b"".join(tensors.raw_bytes(str(tmp_path / "a.bin"), 10, 3)) == (tmp_path / "a.bin").read_bytes()[:10]


def test_container_round_trip_and_damage(spark, tmp_path):
    x = np.concatenate([weights(2500, 8), TRICKY])
    cfg = Config(1e-3, window_bytes=VPW * 4)
    path = str(tmp_path / "x.wp")
    assert container.write_container(plans.compress(as_stream(spark, x), cfg), path, {"mode": "cluster"}) == 3
    assert container.read_footer(path)["mode"] == "cluster"
    assert relative(x, back(plans.decompress(container.read_container(spark, path), VPW), len(x))) <= 1e-3
    whole = (tmp_path / "x.wp").read_bytes()
    for bad in (whole[:-5], b"XXXX" + whole[4:], whole[:4] + b"\x09" + whole[5:], b"", whole[:20]):
        (tmp_path / "bad.wp").write_bytes(bad)
        with pytest.raises(ValueError):
            container.read_footer(str(tmp_path / "bad.wp"))


def test_command_line(spark, tmp_path, capsys):
    np.save(tmp_path / "w.npy", weights(3000, 9))
    source, small = str(tmp_path / "w.npy"), ["-w", "4000"]
    for target in (str(tmp_path / "w.wp"), str(tmp_path / "w.chunks")):
        assert cli.main(["compress", source, target, "-e", "1e-3", "--json", *small], spark) == 0
        assert json.loads(capsys.readouterr().out.splitlines()[-1])["windows"] == 3
        assert cli.main(["verify", source, target, "-e", "1e-3", *small], spark) == 0
        assert cli.main(["verify", source, target, "-e", "1e-9", *small], spark) == 1
        assert cli.main(["decompress", target, str(tmp_path / "back.npy"), *small], spark) == 0
        assert relative(weights(3000, 9), np.load(tmp_path / "back.npy")) <= 1e-3


def test_micro_batches(spark, tmp_path):
    x = weights(2000, 10)
    as_stream(spark, x).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("pos long, x float").parquet(str(tmp_path / "in"))
    compress_stream(live, Config(1e-3, window_bytes=VPW * 4), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert relative(x, back(plans.decompress(got, VPW), len(x))) <= 1e-3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(width=32, allow_subnormal=True), min_size=1, max_size=200), st.sampled_from([0, 200]))
def test_packed_window_is_positional(values, level):
    x = np.array(values, np.float32)
    book, labels = np.unique(np.nan_to_num(x), return_inverse=True)
    at = np.flatnonzero(~np.isfinite(x))
    chunk = packing.pack_window(0, "vq", "absolute", book.reshape(-1, 1), labels, None, None, 0.0, at, x[at], 1, len(x), 1)
    assert np.array_equal(packing.unpack_window(chunk), x, equal_nan=True)


def test_log_bound_is_relative_bound():
    assert math.isclose(math.expm1(math.log1p(1e-3)), 1e-3)
